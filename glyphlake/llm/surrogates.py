"""Keyed surrogates for personal data, in DataFrame functions only.

Found are e-mail addresses, phone numbers, card and account numbers, social security numbers, IPv4 addresses, and names of
persons (after a form of address, or a known given name before a surname). In a document with names, later bare mentions
of the same names are found too.

What refers to one thing gets one surrogate everywhere (coreference): mentions are reduced to a normal form (digits of a
number, lower case of an address or name), and a surrogate is drawn for the pair of kind and normal form by a keyed SHA-256.
It keeps the format: digits for digits in the mention's own punctuation, country codes, the Luhn remainder of card numbers,
octet lengths, letter case and the script of letters; given names keep their gender.

Distinctness is checked, not assumed: a draw that two things share, that an earlier thing has, or that is itself a real
value of the corpus is drawn again with the next counter by all but the least of them, until none is left; after
``rounds`` draws a long unique form ends the matter.

Only documents with a mention are shuffled, and only their mentions meet by value: an address that a third of all
documents holds is first reduced by partial aggregation, and joined by a join that may be split.

Defined results: a null text stays null and an empty one empty, both with no mention; repeated rows get the same text;
empty tables give empty results; extra columns are ignored, and no column but the text is read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from glyphlake.llm.common import Workspace

_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"[\p{L}\p{M}\p{N}_%+-](?:[\p{L}\p{M}\p{N}._%+-]{0,62}[\p{L}\p{M}\p{N}_%+-])?@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}"
CARD = _EDGE + r"(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})" + _END
PHONE = (
    r"(?:(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .-]\d{4}|"
    + _EDGE + r"\d{3}[.-]\d{3}[.-]\d{4})" + _END
)
SSN = _EDGE + r"\d{3}-\d{2}-\d{4}" + _END
IPV4 = r"(?<![\p{L}\p{N}.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?!\.?\d)(?!\p{L})"
BASE = "|".join((EMAIL, IPV4, SSN, PHONE, CARD))

_TITLES = {
    "m": "Mr|Herr|Monsieur|Señor|Sr|Sir|Mister|Lord|г-н|господин|Κος", "f": "Mrs|Ms|Miss|Frau|Fräulein|Madame|Mme|Mademoiselle|Mlle|Señora|Sra|Señorita|Srta|Lady|г-жа|госпожа|Κα",
    "n": "Dr|Prof|Professor",
}
NAMES = {
    ("latin", "f"): "Alice Amelia Beatrice Camille Caroline Charlotte Clara Daniela Eleanor Elisabeth Emily Emma Esther Fiona Gabriela Hannah Helena Ingrid Isabella Jacqueline Jessica Johanna Josephine Judith Julia Katharina Laura Louise Lucia Margaret Mariana Martha Monika Natalie Nicole Olivia Patricia Rebecca Sabine Sarah Sofia Stephanie Susan Teresa Ursula Valentina Veronica Victoria",
    ("latin", "m"): "Albert Alexander Andrew Anthony Benjamin Carlos Charles Christian Christopher Daniel David Diego Edward Fernando François Frederick George Gerhard Gregory Harold Heinrich Henry Hugo Jakob James Johannes John Jonathan Joseph Julian Kenneth Leonard Lorenzo Manuel Matthew Michael Nicholas Oliver Patrick Philip Rafael Richard Robert Samuel Sebastian Stefan Thomas Vincent Walter William",
    ("latin", "n"): "Alexis Avery Cameron Casey Dakota Emerson Finley Jamie Jordan Kendall Morgan Quinn Riley Robin Rowan Sidney Taylor",
    ("latin", "s"): "Abbott Albrecht Andersen Baker Barnes Becker Bennett Bernard Bishop Blanchard Carpenter Chambers Coleman Cooper Crawford Delgado Dubois Edwards Ferguson Fischer Fletcher Fontaine Garcia Gibson Graham Hamilton Hartmann Hernandez Hoffmann Hughes Jennings Keller Lambert Lawson Lindberg Marchand Martinez Mitchell Moreau Navarro Nicholson Patterson Peterson Ramirez Reynolds Schneider Schreiber Shepherd Sullivan Thompson Torres Vasquez Wagner Whitaker Winkler Zimmermann",
    ("cyrillic", "f"): "Анна Вера Дарья Екатерина Елена Ирина Ксения Мария Надежда Наталья Ольга Светлана Татьяна Юлия",
    ("cyrillic", "m"): "Александр Андрей Борис Виктор Владимир Дмитрий Иван Максим Михаил Николай Олег Павел Сергей Юрий",
    ("cyrillic", "s"): "Белов Виноградов Волков Голубев Жуков Зайцев Козлов Кузнецов Лебедев Морозов Новиков Павлов Соколов Фролов",
    ("greek", "f"): "Αγγελική Αικατερίνη Βασιλική Γεωργία Δήμητρα Ελένη Ιωάννα Μαρία Σοφία Χριστίνα",
    ("greek", "m"): "Αλέξανδρος Ανδρέας Βασίλης Γιώργος Δημήτρης Ιωάννης Κώστας Μιχάλης Νίκος Παναγιώτης",
    ("greek", "s"): "Αντωνίου Βλάχος Γεωργίου Δημητρίου Ιωάννου Καραγιάννης Νικολάου Οικονόμου Παππάς Παπαδόπουλος",
}
_CAP = r"\p{Lu}[\p{Ll}\p{M}]+(?:[-'’]\p{Lu}[\p{Ll}\p{M}]+)*"


def _trie(words: str) -> str:
    """An alternation of words as a pattern that reads each character once."""
    root: dict = {}
    for word in words.split("|"):
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        options = [("\\" + c if c in ".-" else c) + pattern(rest) for c, rest in sorted(node.items()) if c]
        if not options:
            return ""
        body = options[0] if len(options) == 1 else f"(?:{'|'.join(options)})"
        return f"(?:{body})?" if "" in node else body

    return pattern(root)


_GIVEN = {g: "|".join(sorted({w for (_, k), v in NAMES.items() if k == g for w in v.split()})) for g in "fmn"}
TITLED = {g: rf"{_EDGE}(?:{_trie(t)})\.? (?=\p{{Lu}})({_CAP})(?: ({_CAP}))?" for g, t in _TITLES.items()}
KNOWN = {g: rf"{_EDGE}({_trie(w)}) ({_CAP}){_END}" for g, w in _GIVEN.items()}
#: What starts a person's name, for a first look at a text; all titles and given names in one tree.
PERSON = rf"{_EDGE}(?:(?:{_trie('|'.join(_TITLES.values()))})\.?|{_trie('|'.join(_GIVEN.values()))}) \p{{Lu}}[\p{{Ll}}\p{{M}}]"
NUMBERS = "|".join((IPV4, SSN, PHONE, CARD))
_SYLLABLES = {
    "latin": "ba ben cor da del fa fen gar hal jo ka len lo mar mi nel no pa ran ro sal ta ten va ver wil".split(),
    "cyrillic": "ба бел вар го да ден жа зор ка лен мар ни пол ра сав та фер".split(),
    "greek": "βα γο δα ζε κα λε μα νι πο ρα σα τε φι".split(),
}


def _script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").when(x.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def add(total: Column, i: Column) -> Column:
        d = F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0))
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10


def _names_of(text: Column) -> Column:
    """array<struct<kind, name>> of the persons' names that the text introduces."""
    parts = []
    for patterns in (TITLED, KNOWN):
        for g, p in patterns.items():
            one, two = F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.regexp_extract_all(text, F.lit(p), F.lit(2))
            parts.append(F.flatten(F.zip_with(one, two, _introduced(g))))
    return F.array_distinct(F.concat(*parts))


def _introduced(by_title: str) -> Callable[[Column, Column], Column]:
    def named(a: Column, b: Column) -> Column:
        first = F.struct(F.when(b != "", _gender(a, by_title)).otherwise("name:s").alias("kind"), a.alias("name"))
        return F.filter(F.array(first, F.struct(F.lit("name:s").alias("kind"), b.alias("name"))), lambda s: s["name"] != "")

    return named


def _gender(given: Column, by_title: str) -> Column:
    if by_title != "n":
        return F.lit(f"name:{by_title}")
    return F.when(given.rlike(f"^(?:{_GIVEN['f']})$"), "name:f").when(given.rlike(f"^(?:{_GIVEN['m']})$"), "name:m").otherwise("name:n")


def _kind(mention: Column, names: Column) -> Column:
    person = F.try_element_at(F.filter(names, lambda s: (s["name"] == mention) | (F.upper(s["name"]) == mention)), F.lit(1))["kind"]
    return (
        F.when(mention.contains("@"), "email")
        .when(person.isNotNull(), person)
        .when(mention.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$"), "ipv4")
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(mention.rlike(r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})$"), "card")
        .otherwise("phone")
    )


def _normal(kind: Column, mention: Column) -> Column:
    code = F.regexp_extract(mention, r"^\+(\d{1,3})[ .(-]", 1)
    phone = F.concat(F.when(mention.startswith("+"), F.concat(F.lit("+"), code, F.lit(":"))).otherwise(F.lit("")), _digits(F.substring(mention, F.length(code) + 1, F.length(mention))))
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), _digits(mention)).otherwise(F.lower(mention))


def _number(draw: Column, at: int) -> Column:
    """A 48-bit number from twelve hex digits of the draw."""
    return F.conv(F.substring(draw, at, 12), 16, 10).cast("long")


def _many_digits(draw: Column) -> Column:
    return F.concat(*[F.lpad((_number(draw, k) % 1_000_000_000).cast("string"), 9, "0") for k in (1, 13, 25)])


def _letters_like(x: Column, draw: Column) -> Column:
    """Same length and make-up: a letter for a letter of the same script, a digit for a digit, all else as it is."""
    alphabets = {r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя", r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω", r"\p{L}": "abcdefghijklmnopqrstuvwxyz"}

    def swap(i: Column) -> Column:
        c = F.substring(x, i, F.lit(1))
        r = F.conv(F.substring(F.sha2(F.concat_ws("|", draw, i.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
        out = F.when(c.rlike(r"^\p{N}$"), (r % 10).cast("string"))
        for test, letters in alphabets.items():
            out = out.when(c.rlike(f"^{test}$"), F.substring(F.lit(letters), (r % len(letters) + 1).cast("int"), F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), swap), "")


def _octets(normal: Column, draw: Column, strict: bool) -> Column:
    parts = F.split(normal, r"\.")

    def octet(k: int) -> Column:
        r = _number(draw, 1 + 12 * k)
        size = F.length(F.try_element_at(parts, F.lit(k + 1)))
        if not strict:
            return (r % 254 + 1).cast("string")
        return F.when(size == 1, r % 9 + 1).when(size == 2, r % 90 + 10).otherwise(r % 155 + 100).cast("string")

    return F.concat_ws(".", *[octet(k) for k in range(4)])


def _name(kind: Column, normal: Column, draw: Column, attempt: int) -> Column:
    script = _script(normal)
    out = None
    for (s, g), words in NAMES.items():
        listed = F.array(*[F.lit(w.lower()) for w in words.split()])
        pick = F.try_element_at(listed, (_number(draw, 1) % len(words.split()) + 1).cast("int"))
        test = (script == s) & ((kind == f"name:{g}") if (s, g) != (s, "m") or s == "latin" else kind.isin("name:m", "name:n"))
        out = F.when(test, pick) if out is None else out.when(test, pick)
    if attempt < 2:
        return out
    made = None
    for s, parts in _SYLLABLES.items():  # a made-up name; longer with every draw
        listed = F.array(*map(F.lit, parts))
        r = [F.try_element_at(listed, (_number(draw, 3 + 5 * k) % len(parts) + 1).cast("int")) for k in range(min(3 + attempt // 2, 9))]
        made = F.when(script == s, F.concat(*r)) if made is None else made.when(script == s, F.concat(*r))
    female = {"latin": "a", "cyrillic": "а", "greek": "α"}
    male = {"latin": "o", "cyrillic": "ин", "greek": "ος"}
    end = F.when(kind == "name:f", F.try_element_at(F.create_map(*[F.lit(x) for kv in female.items() for x in kv]), script))
    end = end.when(kind == "name:m", F.try_element_at(F.create_map(*[F.lit(x) for kv in male.items() for x in kv]), script)).otherwise("")
    return F.concat(made, end)


def _draw(kind: Column, normal: Column, key: str, attempt: int, last: bool) -> Column:
    """The surrogate's normal form for one attempt."""
    draw = F.sha2(F.concat_ws("|", F.lit(key), kind, normal, F.lit(str(attempt))).cast("binary"), 256)
    if last:
        return F.concat(F.lit("x"), F.substring(draw, 1, 40))
    bare = F.substring_index(normal, ":", -1)
    digits = F.left(_many_digits(draw), F.length(bare))
    body = F.left(digits, F.length(bare) - 1)
    check = (10 - (_luhn(F.concat(body, F.lit("0"))) - _luhn(bare)) % 10) % 10
    keep = F.length(F.regexp_extract(normal, r"^\+(\d*):", 1))
    phone = F.concat(F.regexp_extract(normal, r"^(\+\d*:)", 1), F.left(bare, keep), F.substring(digits, keep + 1, F.length(bare)))
    domain = F.regexp_extract(normal, r"\.([^.]+)$", 1)
    mail = F.concat(_letters_like(F.left(normal, F.length(normal) - F.length(domain)), draw), domain)
    return (
        F.when(kind == "email", mail)
        .when(kind == "ipv4", _octets(normal, draw, attempt < 8))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(digits, 2, 8)))
        .when(kind == "card", F.concat(body, check.cast("int").cast("string")))
        .when(kind == "phone", phone)
        .otherwise(_name(kind, normal, draw, attempt))
    )


def _laid_out(kind: Column, mention: Column, surrogate: Column) -> Column:
    """A surrogate's normal form in the format of the mention."""
    digits = F.substring_index(surrogate, ":", -1)

    def place(i: Column) -> Column:
        c = F.substring(mention, i, F.lit(1))
        return F.when(c.rlike("^[0-9]$"), F.substring(digits, F.length(_digits(F.substring(mention, F.lit(1), i))), F.lit(1))).otherwise(c)

    def cased(i: Column) -> Column:
        c = F.substring(surrogate, i, F.lit(1))
        return F.when(F.substring(mention, i, F.lit(1)).rlike(r"^\p{Lu}$"), F.upper(c)).otherwise(c)

    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(mention), F.lit(1))), place), "")
    mail = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(surrogate), F.lit(1))), cased), "")
    shout = (mention == F.upper(mention)) & (F.length(mention) > 1)
    return (
        F.when(surrogate.startswith("x") & (F.length(surrogate) == 41), surrogate)
        .when(kind == "email", mail)
        .when(kind.isin("phone", "card", "ssn"), numbers)
        .when(kind.startswith("name:"), F.when(shout, F.upper(surrogate)).otherwise(F.initcap(surrogate)))
        .otherwise(surrogate)
    )


def surrogate_map(entities: DataFrame, key: str, ws: Workspace, rounds: int = 12) -> DataFrame:
    """``(kind, normal)``, distinct -> with ``surrogate``: distinct within a kind, and no real value of that kind."""
    entities = ws.save(entities, "entities")
    family = F.when(F.col("kind").startswith("name:"), "name").otherwise(F.col("kind"))  # names of all sorts must differ
    real = entities.select(family.alias("family"), F.col("normal").alias("drawn")).distinct()
    left, done = entities, []
    for attempt in range(rounds + 1):
        drawn = left.withColumn("drawn", _draw(F.col("kind"), F.col("normal"), key, attempt, attempt == rounds)).withColumn("family", family)
        best = drawn.groupBy("family", "drawn").agg(F.min(F.struct("kind", "normal")).alias("first"))
        best = best.join(real, ["family", "drawn"], "left_anti")
        for before in done:
            best = best.join(before.select("family", "drawn"), ["family", "drawn"], "left_anti")
        won = ws.save(best.select("family", "drawn", "first.kind", "first.normal"), "drawn")
        done.append(won)
        left = ws.save(left.join(won.select("kind", "normal"), ["kind", "normal"], "left_anti"), "left")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).select("kind", "normal", F.col("drawn").alias("surrogate"))


def replace_personal_data(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = 12) -> DataFrame:
    """One row per document: id, text with surrogates, n_mentions, kinds (count of each kind)."""
    ws = Workspace(docs.sparkSession, "surrogates")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    t = F.col("text")
    touched = F.coalesce((t.contains("@") & t.rlike(EMAIL)) | (t.rlike("[0-9]") & t.rlike(NUMBERS)) | t.rlike(PERSON), F.lit(False))
    clean = rows.where(~touched).select("id", "text", F.lit(0).cast("long").alias("n"), F.lit("").alias("kinds"))

    held = rows.where(touched).withColumn("names", _names_of(F.col("text")))
    spelt = F.flatten(F.transform("names", lambda s: F.array(s["name"], F.upper(s["name"]))))
    quoted = F.transform(F.array_distinct(spelt), lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E")))
    pattern = F.when(F.size("names") == 0, F.lit(BASE)).otherwise(F.concat(F.lit(BASE + "|" + _EDGE + "(?:"), F.array_join(quoted, "|"), F.lit(")" + _END)))
    held = held.withColumn("pattern", pattern).select(
        "id", "text", "names", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("found"), F.split("text", F.col("pattern"), -1).alias("gaps")
    )
    held = ws.save(held.withColumn("at", F.xxhash64("id", "text")), "held")  # only documents with a mention
    mentions = held.select("id", "at", "names", F.posexplode("found").alias("k", "mention")).withColumn("kind", _kind(F.col("mention"), F.col("names")))
    mentions = mentions.select("id", "at", "k", "mention", "kind", _normal(F.col("kind"), F.col("mention")).alias("normal"))
    known = surrogate_map(mentions.select("kind", "normal").distinct(), key, ws, rounds)
    named = mentions.join(known, ["kind", "normal"]).withColumn("new", _laid_out(F.col("kind"), F.col("mention"), F.col("surrogate")))
    per_doc = named.groupBy("id", "at").agg(F.array_sort(F.collect_set(F.struct("k", "new", "kind"))).alias("new"))
    per_doc = per_doc.select(F.col("id").alias("i"), F.col("at").alias("a"), "new")
    built = held.join(per_doc, F.col("id").eqNullSafe(F.col("i")) & (F.col("at") == F.col("a")), "left").withColumn("new", F.coalesce("new", F.expr("cast(array() as array<struct<k:int,new:string,kind:string>>)")))
    text = F.array_join(F.zip_with("gaps", "new", lambda g, n: F.concat(F.coalesce(g, F.lit("")), F.coalesce(n["new"], F.lit("")))), "")
    each = F.array_sort(F.array_distinct(F.transform("new", lambda n: F.substring_index(n["kind"], ":", 1))))
    kinds = F.array_join(F.transform(each, lambda k: F.concat(k, F.lit(":"), F.size(F.filter("new", lambda n: F.substring_index(n["kind"], ":", 1) == k)).cast("string"))), ",")
    changed = built.select("id", text.alias("text"), F.size("new").cast("long").alias("n"), kinds.alias("kinds"))
    return clean.unionByName(changed).select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.col("n").alias("n_mentions"), "kinds")
