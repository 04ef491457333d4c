"""Running a set of rules: selection, union, suppression, location, fixes, output forms and totals."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from glyphlake.functions import text as T
from glyphlake.operators.facts import Facts, at_home, located
from glyphlake.operators.ranges import after
from glyphlake.parse.facts import Options
from glyphlake.rules.stdlib import RULES, Rule, info_string, render_compat
from glyphlake.sources.config import Config
from glyphlake.sources.scratch import spread, written
from glyphlake.tex.render import Profile

SUPPRESSION = "suppression"


class UnknownRule(ValueError):
    """A name that no rule has; tells the nearest one."""


def suggestion(name: str, names: list[str], least: float = 0.7) -> str | None:
    best = max(names, key=lambda n: T.jaro_winkler(name, n), default=None)
    return best if best is not None and T.jaro_winkler(name, best) >= least else None


def suggestions(names: DataFrame, pool: list[str] | None = None, least: float = 0.7) -> DataFrame:
    """(name, nearest): the most similar rule of each name, null below the threshold. ``pool`` is a catalogue's size."""
    rows = names.withColumn("known", F.explode(F.array(*map(F.lit, sorted(pool or RULES))))).withColumn("score", F.round(T.similarity("name", "known"), 9))
    best = F.max(F.when(F.col("score") >= least, F.struct("score", "known")))
    return rows.groupBy("name").agg(best.alias("x")).select("name", F.col("x.known").alias("nearest"))


class RuleSet:
    """An ordered set of rules with unique names."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules: dict[str, Rule] = {}
        for r in rules if rules is not None else [r for r in RULES.values() if r.default]:
            self.add(r)

    def add(self, rule: Rule) -> None:
        if rule.name in self.rules:
            raise ValueError(f"rule {rule.name} is there already")
        self.rules[rule.name] = rule

    def remove(self, name: str) -> None:
        self.rules.pop(name, None)

    def __contains__(self, name: str) -> bool:
        return name in self.rules

    def __len__(self) -> int:
        return len(self.rules)

    def names(self) -> list[str]:
        return list(self.rules)

    def by_name(self, name: str) -> Rule | None:
        return self.rules.get(name)


def _known(name: str, pool: dict[str, Rule]) -> str:
    if name not in pool:
        near = suggestion(name, list(pool))
        raise UnknownRule(f"no rule {name}" + (f"; did you mean {near}?" if near else ""))
    return name


def select(spec: str, pool: dict[str, Rule] | None = None) -> RuleSet:
    """``default,-bare-url,+escaped-emphasis``, read from left to right; also ``all`` and ``none``."""
    pool = pool or RULES
    chosen: dict[str, None] = {}
    for part in (p.strip() for p in spec.split(",")):
        if part in ("default", "all", "none"):
            chosen = {n: None for n, r in pool.items() if part == "all" or (part == "default" and r.default)}
        elif part.startswith("-"):
            chosen.pop(_known(part[1:], pool), None)
        elif part:
            chosen[_known(part.lstrip("+"), pool)] = None
    return RuleSet([r for n, r in pool.items() if n in chosen])


def select_by_config(preset: str = "default", chosen: list[str] | None = None, extend: list[str] = (), ignore: list[str] = (), pool: dict[str, Rule] | None = None) -> RuleSet:
    """Preset (or an explicit list) plus extensions minus what is ignored."""
    pool = pool or RULES
    names = {_known(n, pool) for n in chosen} if chosen is not None else {n for n, r in pool.items() if preset == "all" or (preset == "default" and r.default)}
    names = (names | {_known(n, pool) for n in extend}) - {_known(n, pool) for n in ignore}
    return RuleSet([r for n, r in pool.items() if n in names])


def configured(config: Config) -> RuleSet:
    """The rules that a configuration selects, with its own languages, renderer, packages and macros in them."""
    lint = config.lint
    pool = dict(RULES)
    if lint.info_strings:
        pool["info-string-typo"] = replace(RULES["info-string-typo"], check=lambda facts: info_string(facts, tuple(lint.info_strings)))
    profile = Profile(lint.renderer, frozenset(lint.packages), dict(lint.macros))
    if profile != Profile():
        pool["math/render-compat"] = replace(RULES["math/render-compat"], check=lambda facts: render_compat(facts, profile))
    return select_by_config(lint.preset, lint.select, lint.extend_select, lint.ignore, pool)


def catalogue(spark: SparkSession, pool: dict[str, Rule] | None = None) -> DataFrame:
    """The rules as a small table."""
    rows = [(k, r.name, r.description, r.default, r.advisory, r.fixes) for k, r in enumerate((pool or RULES).values())]
    return spark.createDataFrame(rows, "ord int, name string, description string, is_default boolean, is_advisory boolean, fixes string")


def explain(name: str) -> str:
    r = RULES[_known(name, RULES)]
    flags = [w for w, on in (("on by default", r.default), ("advisory", r.advisory), (f"{r.fixes} fix", r.fixes)) if on]
    return f"{r.name}: {r.description} ({', '.join(flags) or 'off by default'})"


def rule_pages(spark: SparkSession) -> DataFrame:
    """(path, text): a page of documentation for each rule."""
    flags = F.concat_ws(", ", F.when(F.col("is_default"), "on by default").otherwise("off by default"), F.when(F.col("is_advisory"), "advisory"), F.when(F.col("fixes") != "", F.concat("fixes", F.lit(" fix"))))
    text = F.concat(F.lit("# "), "name", F.lit("\n\n"), "description", F.lit(".\n\n"), flags, F.lit("\n"))
    return catalogue(spark).select(F.concat(F.lit("rules/"), "name", F.lit(".md")).alias("path"), text.alias("text"))


def suppressed_ranges(facts: Facts) -> DataFrame:
    """(doc_id, rule, s, e): where a rule is silent; rule '' stands for all. Regions end at the next ``enable`` or the end."""
    rows = facts.table("suppressions").select("doc_id", F.col("text").alias("rule"), "kind", "s", "e", "n")
    order = W.partitionBy("doc_id", "rule").orderBy("s")
    switches = rows.where("kind in ('disable', 'enable')").withColumn("before", F.lag("kind").over(order))
    switches = switches.withColumn("end", F.min(F.when(F.col("kind") == "enable", F.col("s"))).over(after("doc_id", "rule")))
    regions = switches.where("kind = 'disable' and (before is null or before = 'enable')").select("doc_id", "rule", F.col("e").alias("s"), F.coalesce("end", F.lit(2147483647)).alias("e"))
    single = rows.where("kind in ('allow', 'allow-next-line')").select("doc_id", "rule", F.col("e").alias("s"), F.col("n").alias("e"))
    return regions.unionByName(single)


def unknown_names(facts: Facts, known: list[str]) -> DataFrame:
    """Names in directives that no rule has: an anti join with the catalogue, as advisory findings."""
    names = facts.docs.sparkSession.createDataFrame([(n,) for n in [*known, ""]], "known string")
    rows = facts.table("suppressions").join(F.broadcast(names), F.col("text") == F.col("known"), "left_anti")
    return rows.select("doc_id", "s", "e", F.concat(F.lit("unknown rule "), "text").alias("message"), F.lit(None).cast("string").alias("replacement"), F.lit(False).alias("safe"))


def stamped(rows: DataFrame, rule: Rule) -> DataFrame:
    """Findings with their rule's name and kind. A rule of several codes names its findings itself; those names stay."""
    name = F.coalesce(F.nullif(F.col("rule"), F.lit("")), F.lit(rule.name)) if "rule" in rows.columns else F.lit(rule.name)
    return rows.withColumns({"rule": name, "advisory": F.lit(rule.advisory)})


def diagnostics(docs: DataFrame, rules: RuleSet | None = None, suppress: bool = True, options: Options | None = None, locate: bool = True, share: bool | None = None, known: list[str] | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, rule, line, col, span_start, span_end, message, advisory, replacement, safe).

    Facts of several kinds are written once: every plan that reads one would parse the corpus again.
    """
    rules = RuleSet() if rules is None else rules
    wanted = {n for r in rules.rules.values() for n in r.needs} | ({"suppressions"} if suppress else set())
    marks = [r.marks for r in rules.rules.values() if "prose" in r.needs]
    facts = Facts(docs, sorted(wanted), options, share=len(wanted) > 1 if share is None else share, marks=None if None in marks else "".join(marks) or None)
    parts = [stamped(r.check(facts), r) for r in rules.rules.values()]
    if not parts:
        parts = [unknown_names(facts, list(RULES)).where("false").withColumns({"rule": F.lit(""), "advisory": F.lit(False)})]
    rows = reduce(DataFrame.unionByName, parts)
    if suppress:
        # One row a document, joined once: an anti join would be pushed below the union and planned again for every rule.
        silent = suppressed_ranges(facts).groupBy(F.col("doc_id").alias("_d")).agg(F.collect_list(F.struct("rule", "s", "e")).alias("_silent"))
        inside = F.exists("_silent", lambda r: ((r["rule"] == "") | (r["rule"] == F.col("rule"))) & (r["s"] <= F.col("s")) & (F.col("s") < r["e"]))
        rows = rows.join(at_home(silent), F.col("doc_id") == F.col("_d"), "left").where(~F.coalesce(inside, F.lit(False))).drop("_d", "_silent")
        rows = rows.unionByName(unknown_names(facts, known or list(RULES)).withColumns({"rule": F.lit(SUPPRESSION), "advisory": F.lit(True)}))
    if locate:
        rows = located(rows, facts.docs).withColumns({"line": F.col("line").cast("long"), "col": F.col("col").cast("long")})
    where = ["line", "col"] if locate else []
    return rows.select("doc_id", "rule", *where, F.col("s").cast("long").alias("span_start"), F.col("e").cast("long").alias("span_end"), "message", "advisory", "replacement", "safe")


def ordinal(*ties: str) -> Column:
    """The place of a finding in its document's final order."""
    return F.row_number().over(W.partitionBy("doc_id").orderBy("line", "col", "rule", "span_end", *ties))


def in_order(rows: DataFrame) -> DataFrame:
    """The final order: by document, place and rule."""
    return rows.orderBy("doc_id", "line", "col", "rule", "span_end")


def fixed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text, n_fixes): safe fixes applied from the end of each text, skipping those that overlap one applied."""
    key = F.struct(F.col("span_start").cast("int").alias("s"), F.col("ord"), F.col("span_end").cast("int").alias("e"), F.col("replacement").alias("r"))
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("span_start", "rule", "span_end"))
    edits = found.where("safe and replacement is not null").withColumn("ord", order).groupBy("doc_id").agg(F.collect_list(key).alias("edits"))
    rows = docs.join(at_home(edits.withColumnRenamed("doc_id", "_d")), F.col("doc_id") == F.col("_d"), "left")
    kept = F.coalesce(T.greedy_from_the_end(F.col("edits")), F.expr("cast(array() as array<struct<s:int,ord:int,e:int,r:string>>)"))
    return rows.select("doc_id", "text", kept.alias("kept")).select("doc_id", T.splice(F.col("text"), F.col("kept")).alias("text"), F.size("kept").cast("long").alias("n_fixes"))


def left_after_fixes(docs: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """What is found in the fixed texts, without lines and columns.

    A text without a fix stays as it is and so do its findings, which are known; every changed text is parsed and checked again.
    """
    before = written(diagnostics(docs, rules, locate=False), "found")
    changed = written(fixed(docs, before).where("n_fixes > 0").select("doc_id", "text"), "fixed")
    same = before.join(at_home(changed.select("doc_id")), "doc_id", "left_anti")
    return same.unionByName(diagnostics(spread(changed, 4), rules, locate=False))


def totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("n_diagnostics"), F.count_if(~F.col("advisory")).alias("n_failing"), F.count_if(F.col("safe") & F.col("replacement").isNotNull()).alias("n_fixable"))


def exit_status(n_failing: Column, parse_errors: Column, check: bool) -> Column:
    return F.when(parse_errors > 0, 2).when((n_failing > 0) & F.lit(check), 1).otherwise(0)


def compact(found: DataFrame, path: str = "path") -> DataFrame:
    return found.select(F.concat_ws(":", path, "line", "col", F.concat(F.lit(" "), "rule"), F.concat(F.lit(" "), "message")).alias("value"))


def json_lines(found: DataFrame, docs: DataFrame, base_url: str = "", path: str = "path", version: int = 2) -> DataFrame:
    """One JSON object per finding; a missing fix is left out."""
    fix = F.when(F.col("replacement").isNotNull(), F.struct("replacement", "safe"))
    if version == 1:
        return found.select(F.to_json(F.struct(F.col(path).alias("path"), "rule", "line", F.col("col").alias("column"), "message", "advisory")).alias("value"))
    about = catalogue(found.sparkSession).select(F.col("name").alias("_n"), "description")
    rows = found.join(F.broadcast(about), F.col("rule") == F.col("_n"), "left").join(at_home(docs.select("doc_id", F.col("text").alias("_t"))), "doc_id")
    snippet = T.bytes_of(F.col("_t"), F.col("span_start").cast("int"), F.col("span_end").cast("int"))
    record = F.struct(
        F.lit(2).alias("schema_version"), F.col(path).alias("path"), F.when(F.col("advisory"), "advisory").otherwise("warning").alias("severity"),
        F.struct(F.col("rule").alias("name"), "description", T.rule_url(base_url, F.col("rule")).alias("url")).alias("rule"),
        F.struct("line", F.col("col").alias("column"), "span_start", "span_end", snippet.alias("snippet")).alias("source"), "message", fix.alias("fix"),
    )
    return rows.select(F.to_json(record).alias("value"))


def pretty(found: DataFrame, docs: DataFrame, path: str = "path") -> DataFrame:
    """The line with carets under the finding, and its fix."""
    rows = found.join(at_home(docs.select("doc_id", F.col("text").alias("_t"))), "doc_id")
    line = F.element_at(F.split("_t", "\n", -1), F.col("line").cast("int"))
    span = T.bytes_of(F.col("_t"), F.col("span_start").cast("int"), F.col("span_end").cast("int"))
    width = F.greatest(F.length(F.substring_index(span, "\n", 1)), F.lit(1))
    help_ = F.when(F.col("replacement").isNotNull(), F.concat(F.lit("\n  = "), F.when(F.col("safe"), "fix").otherwise("suggestion"), F.lit(": "), F.to_json(F.struct("replacement")))).otherwise("")
    text = F.concat(F.when(F.col("advisory"), "advisory").otherwise("warning"), F.lit("["), "rule", F.lit("]: "), "message", F.lit("\n --> "), F.concat_ws(":", path, "line", "col"),
                    F.lit("\n  | "), line, F.lit("\n  | "), F.repeat(F.lit(" "), (F.col("col") - 1).cast("int")), F.repeat(F.lit("^"), width), help_)
    return rows.select(text.alias("value"))
