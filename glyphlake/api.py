"""The library's front door: corpora in, DataFrames out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphlake.fmt.engine import formatted
from glyphlake.parse.facts import parse
from glyphlake.render.html import rendered
from glyphlake.rules.run import RuleSet, configured, diagnostics, fixed
from glyphlake.rules.stdlib import RULES, Rule
from glyphlake.sources.config import Config, Fmt
from glyphlake.tex.translate import translated_regions


class Engine:
    """A configuration and the rules known to it; a program adds its own with ``register``."""

    def __init__(self, config: Config | None = None):
        self.config, self.pool = config or Config(), dict(RULES)

    def register(self, rule: Rule) -> None:
        if rule.name in self.pool:
            raise ValueError(f"rule {rule.name} is there already")
        self.pool[rule.name] = rule

    def rules(self) -> RuleSet:
        return RuleSet([*configured(self.config).rules.values(), *(r for n, r in self.pool.items() if n not in RULES and r.default)])

    def check(self, docs: DataFrame, **options) -> DataFrame:
        return diagnostics(docs, self.rules(), known=list(self.pool), **options)

    def fix(self, docs: DataFrame) -> DataFrame:
        return fixed(docs, self.check(docs, locate=False))

    def format(self, docs: DataFrame, options: Fmt | None = None) -> DataFrame:
        return formatted(docs, options or self.config.fmt)

    def render(self, docs: DataFrame) -> DataFrame:
        return rendered(docs, self.config.render_profile)

    def translate(self, docs: DataFrame, to: str) -> DataFrame:
        return translated_regions(docs, to)


@F.udtf(returnType="s int, e int, text string, kind string")
class MarkdownFacts:
    """``md_facts(text, fact)`` for SQL: the facts of one kind in one text; places are bytes."""

    def eval(self, text: str, fact: str) -> Iterator[tuple]:
        for f in parse(text or "").facts.get(fact, []):
            yield f["s"], f["e"], f.get("text"), f.get("kind")


def register_functions(spark: SparkSession) -> None:
    spark.udtf.register("md_facts", MarkdownFacts)
