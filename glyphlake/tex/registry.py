"""TeX commands and what they stand for. Built from the Unicode names of letters and operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_GREEK = "alpha α beta β gamma γ delta δ epsilon ε varepsilon ϵ zeta ζ eta η theta θ vartheta ϑ iota ι kappa κ varkappa ϰ lambda λ mu μ nu ν xi ξ pi π varpi ϖ rho ρ varrho ϱ sigma σ varsigma ς tau τ upsilon υ phi φ varphi ϕ chi χ psi ψ omega ω Gamma Γ Delta Δ Theta Θ Lambda Λ Xi Ξ Pi Π Sigma Σ Upsilon Υ Phi Φ Psi Ψ Omega Ω"
_OPERATORS = "boxtimes ⊠ pm ± mp ∓ times × div ÷ cdot ⋅ ast ∗ star ⋆ circ ∘ bullet • oplus ⊕ ominus ⊖ otimes ⊗ oslash ⊘ odot ⊙ cap ∩ cup ∪ uplus ⊎ sqcap ⊓ sqcup ⊔ vee ∨ wedge ∧ setminus ∖ wr ≀ dagger † ddagger ‡ amalg ⨿ diamond ⋄ triangleleft ◁ triangleright ▷ land ∧ lor ∨"
_RELATIONS = "leqslant ⩽ geqslant ⩾ nsubset ⊄ nsupset ⊅ nsupseteq ⊉ subsetneq ⊊ supsetneq ⊋ nprec ⊀ leq ≤ le ≤ geq ≥ ge ≥ neq ≠ ne ≠ equiv ≡ sim ∼ simeq ≃ approx ≈ cong ≅ propto ∝ prec ≺ succ ≻ preceq ≼ succeq ≽ ll ≪ gg ≫ subset ⊂ supset ⊃ subseteq ⊆ supseteq ⊇ sqsubseteq ⊑ sqsupseteq ⊒ in ∈ ni ∋ notin ∉ vdash ⊢ dashv ⊣ models ⊨ perp ⊥ mid ∣ parallel ∥ asymp ≍ bowtie ⋈ doteq ≐"
_ARROWS = "Longrightarrow ⟹ Longleftarrow ⟸ dashrightarrow ⇢ curvearrowright ↷ rightsquigarrow ↝ leftarrow ← gets ← to → rightarrow → leftrightarrow ↔ Leftarrow ⇐ Rightarrow ⇒ Leftrightarrow ⇔ uparrow ↑ downarrow ↓ updownarrow ↕ Uparrow ⇑ Downarrow ⇓ mapsto ↦ longrightarrow ⟶ longleftarrow ⟵ implies ⟹ iff ⟺ hookrightarrow ↪ hookleftarrow ↩ nearrow ↗ searrow ↘ swarrow ↙ nwarrow ↖ rightharpoonup ⇀ leftharpoonup ↼"
_LARGE = "bigsqcup ⨆ sum ∑ prod ∏ coprod ∐ int ∫ iint ∬ iiint ∭ oint ∮ bigcap ⋂ bigcup ⋃ bigvee ⋁ bigwedge ⋀ bigoplus ⨁ bigotimes ⨂"
_MISC = "complement ∁ lbrace { rbrace } lvert | rvert | infty ∞ partial ∂ nabla ∇ forall ∀ exists ∃ nexists ∄ emptyset ∅ varnothing ∅ neg ¬ lnot ¬ top ⊤ bot ⊥ angle ∠ triangle △ square □ ell ℓ hbar ℏ Re ℜ Im ℑ aleph ℵ beth ℶ wp ℘ prime ′ dots … ldots … cdots ⋯ vdots ⋮ ddots ⋱ surd √ degree ° flat ♭ natural ♮ sharp ♯ clubsuit ♣ diamondsuit ♢ heartsuit ♡ spadesuit ♠ langle ⟨ rangle ⟩ lfloor ⌊ rfloor ⌋ lceil ⌈ rceil ⌉ Vert ‖ lVert ‖ rVert ‖ backslash \\ therefore ∴ because ∵ checkmark ✓ imath ı jmath ȷ"


def _pairs(words: str) -> dict[str, str]:
    w = words.split()
    return dict(zip(w[::2], w[1::2], strict=True))


CATEGORIES = {"greek": _GREEK, "operator": _OPERATORS, "relation": _RELATIONS, "arrow": _ARROWS, "large": _LARGE, "symbol": _MISC}
SYMBOLS: dict[str, str] = {}
CATEGORY: dict[str, str] = {}
for _name, _words in CATEGORIES.items():
    SYMBOLS |= _pairs(_words)
    CATEGORY |= {k: _name for k in _pairs(_words)}
#: The preferred command of a character: the first one listed. ASCII characters stand for themselves.
COMMANDS: dict[str, str] = {}
for _k, _v in SYMBOLS.items():
    if not _v.isascii():
        COMMANDS.setdefault(_v, _k)

FUNCTIONS = "im coker sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh coth log ln lg exp det dim ker hom deg gcd max min sup inf lim limsup liminf arg Pr".split()
PARSED = "frac dfrac tfrac binom sqrt left right begin end text mathrm mathbf mathbb mathcal mathfrak mathsf mathtt mathit operatorname overline underline hat bar vec dot ddot tilde widehat widetilde boldsymbol mathop stackrel overset underset".split()
SILENT = "displaystyle textstyle scriptstyle limits nolimits quad qquad".split()
UNSUPPORTED = "newcommand renewcommand def let require input include label ref eqref tag cite href url color textcolor includegraphics hspace vspace phantom".split()
for _words, _cat in ((FUNCTIONS, "function"), (PARSED, "parsed"), (SILENT, "silent"), (UNSUPPORTED, "unsupported")):
    CATEGORY |= dict.fromkeys(_words, _cat)

SUPER = dict(zip("0123456789+-=()niabcdefghjklmoprstuvwxyzTABDEGHIJKLMNOPRUVW", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱᵃᵇᶜᵈᵉᶠᵍʰʲᵏˡᵐᵒᵖʳˢᵗᵘᵛʷˣʸᶻᵀᴬᴮᴰᴱᴳᴴᴵᴶᴷᴸᴹᴺᴼᴾᴿᵁⱽᵂ", strict=True))
SUB = dict(zip("0123456789+-=()aehijklmnoprstuvx", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ", strict=True))
UNSUPER, UNSUB = {v: k for k, v in SUPER.items()}, {v: k for k, v in SUB.items()}
ACCENTS = {"hat": "\u0302", "bar": "\u0305", "vec": "\u20d7", "dot": "\u0307", "ddot": "\u0308", "tilde": "\u0303", "underline": "\u0332"}


def _alphabet(upper: int, lower: int | None, digits: int | None = None, holes: str = "") -> dict[str, str]:
    out = {chr(65 + k): chr(upper + k) for k in range(26)}
    if lower:
        out |= {chr(97 + k): chr(lower + k) for k in range(26)}
    if digits:
        out |= {chr(48 + k): chr(digits + k) for k in range(10)}
    w = holes.split()
    return out | dict(zip(w[::2], w[1::2], strict=True))


ALPHABETS = {
    "mathbb": _alphabet(0x1D538, 0x1D552, 0x1D7D8, "C ℂ H ℍ N ℕ P ℙ Q ℚ R ℝ Z ℤ"), "mathbf": _alphabet(0x1D400, 0x1D41A, 0x1D7CE),
    "mathcal": _alphabet(0x1D49C, 0x1D4B6, None, "B ℬ E ℰ F ℱ H ℋ I ℐ L ℒ M ℳ R ℛ e ℯ g ℊ o ℴ"), "mathfrak": _alphabet(0x1D504, 0x1D51E, None, "C ℭ H ℌ I ℑ R ℜ Z ℨ"),
    "mathsf": _alphabet(0x1D5A0, 0x1D5BA, 0x1D7E2), "mathtt": _alphabet(0x1D670, 0x1D68A, 0x1D7F6),
}
FROM_ALPHABET = {c: (name, k) for name, table in ALPHABETS.items() for k, c in table.items() if c not in COMMANDS}
ENVIRONMENTS = "equation align gather multline alignat flalign eqnarray split cases matrix pmatrix bmatrix vmatrix Vmatrix Bmatrix smallmatrix array aligned gathered alignedat".split()
#: Commands that need a package, by renderer.
PACKAGES = {"ce": "mhchem", "pu": "mhchem", "cancel": "cancel", "bcancel": "cancel", "xcancel": "cancel", "textcolor": "color", "color": "color", "bra": "braket", "ket": "braket", "braket": "braket", "dv": "physics", "pdv": "physics", "qty": "physics", "unicode": "unicode", "enclose": "enclose", "SI": "siunitx", "si": "siunitx"}


def commands(spark: SparkSession) -> DataFrame:
    """(name, category, symbol, preferred): the registry as a small table; ``preferred`` is the name a symbol goes back to."""
    rows = [(n, c, SYMBOLS.get(n), COMMANDS.get(SYMBOLS.get(n)) == n) for n, c in CATEGORY.items()]
    return spark.createDataFrame(rows, "name string, category string, symbol string, preferred boolean")


def scripted(text: Column, table: dict[str, str]) -> Column:
    """The text in super- or subscript characters (``SUPER`` or ``SUB``); null if one of its characters has no such form."""
    inside = "".join("\\" + c if c in "^-]\\" else c for c in table)
    return F.when(text.rlike(f"^[{inside}]+$"), F.translate(text, "".join(table), "".join(table.values())))
