"""Regex rules: loading, matching, boosts, and alerts that name labels."""

from __future__ import annotations

import json
import os
import re
from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.errors import InvalidConfig, PatternError, TooLarge, Unsupported
from loomtext.sources.security import MAX_RULE_BYTES, MAX_RULES, read_text

HIT = "array<struct<title:string,description:string,score:double>>"
#: The largest boost, in points of a hundred.
BOOST_CAP = 100.0


@dataclass(frozen=True)
class Rule:
    title: str
    description: str
    match_rule: str
    score: float
    target_labels: tuple[str, ...] = ()


class RuleMatcher(ABC):
    """Anything that gives the hits of a text as a column."""

    @abstractmethod
    def hits(self, text: Column) -> Column:
        """An array of (title, description, score), in rule order, at most one for each rule."""


def java_pattern(pattern: str) -> str:
    """The pattern with Unicode classes, which is how the rules are meant."""
    return "(?U)" + pattern


def check_pattern(spark: SparkSession, pattern: str) -> None:
    try:
        spark._jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
    except Exception as e:
        raise PatternError("rule", f"{pattern!r} doesn't compile") from e


@dataclass
class RegexMatcher(RuleMatcher):
    """All rules in one projection of rlike columns: no join, one scan of each text for each rule."""

    rules: list[Rule] = field(default_factory=list)

    @classmethod
    def checked(cls, spark: SparkSession, rules: list[Rule]) -> RegexMatcher:
        for r in rules:
            check_pattern(spark, r.match_rule)
        return cls(list(rules))

    def hits(self, text: Column) -> Column:
        if not self.rules:
            return F.array().cast(HIT)
        each = [F.when(text.rlike(java_pattern(r.match_rule)), F.struct(F.lit(r.title).alias("title"), F.lit(r.description).alias("description"), F.lit(float(r.score)).alias("score"))) for r in self.rules]
        return F.filter(F.array(*each), lambda h: h.isNotNull())


def build_matcher(spark: SparkSession, rules: list[Rule], backend: str = "Regex") -> RuleMatcher:
    if backend.lower() == "regex":
        return RegexMatcher.checked(spark, rules)
    if backend.lower() == "vectorscan":
        raise Unsupported("matcher", "the Vectorscan backend isn't available; use Regex")
    raise InvalidConfig("matcher", f"unknown backend {backend!r}")


def find_matches(text: Column, matchers: list[RuleMatcher]) -> Column:
    """The hits of all matchers, one after the other."""
    return F.concat(*(m.hits(text) for m in matchers)) if matchers else F.array().cast(HIT)


def rule_boost(hits: Column) -> Column:
    """The sum of hit scores, at most BOOST_CAP; negative sums stay."""
    return F.least(F.lit(BOOST_CAP), F.aggregate(hits, F.lit(0.0), lambda s, h: s + h["score"]))


def merge_scores(base: Column, boost: Column, add: bool) -> Column:
    return F.least(F.lit(1.0), base + boost / 100.0) if add else base


def apply_rules(scored: DataFrame, matchers: list[RuleMatcher], add: bool, text: str = "text") -> DataFrame:
    """labels (an array of label and score) with the hits of the matchers as extra_hits; boosted and ranked again with add on.

    Hits are told whether or not they count. A null text has none.
    """
    hits = scored.withColumn("extra_hits", F.coalesce(find_matches(F.col(text), matchers), F.array().cast(HIT)))
    return hits.withColumn("labels", boosted(F.col("labels"), F.col("extra_hits"))) if add and matchers else hits


def boosted(labels: Column, hits: Column) -> Column:
    """Ranked labels with the boost of the hits; it is the same for every label of a document, so only the
    cap at 1 can change their order, and ties go to the label that comes first."""
    each = F.transform(labels, lambda x: F.struct((-merge_scores(x["score"], rule_boost(hits), True)).alias("s"), x["label"].alias("label")))
    return F.transform(F.array_sort(each), lambda x: F.struct(x["label"].alias("label"), (-x["s"]).alias("score")))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(i, r.title, r.description, r.match_rule, float(r.score), list(r.target_labels)) for i, r in enumerate(rules)], "rule_id int, title string, description string, match_rule string, score double, target_labels array<string>")


def match_join(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, rule_id, score) by a join of documents with a table of rules, for rules that aren't literals.

    Over MAX_RULES rules are an error, as in rule files, so what is broadcast is bounded.
    """
    if len(rules.take(MAX_RULES + 1)) > MAX_RULES:
        raise TooLarge("rules", f"over {MAX_RULES} rules")
    pattern = F.concat(F.lit("(?U)"), F.col("match_rule"))
    return docs.join(F.broadcast(rules), F.call_function("rlike", F.col("text"), pattern)).select("doc_id", "rule_id", "score")


# --- loading ---


def _rule(item: object, where: str) -> Rule:
    if not isinstance(item, dict) or not {"title", "match_rule", "score"} <= item.keys():
        raise InvalidConfig("rules", f"{where}: a rule needs title, match_rule and score")
    return Rule(str(item["title"]), str(item.get("description", "")), str(item["match_rule"]), float(item["score"]), tuple(map(str, item.get("target_labels") or ())))


def _listed(data: object, path: str) -> list[Rule]:
    if not isinstance(data, list):
        raise InvalidConfig("rules", f"{path} must hold a list of rules")
    return [_rule(x, path) for x in data]


def load_json_rules(path: str) -> list[Rule]:
    try:
        return _limited(_listed(json.loads(read_text(path)), path))
    except json.JSONDecodeError as e:
        raise InvalidConfig("rules", f"{path}: {e}") from e


def load_yaml_rules(path: str) -> list[Rule]:
    try:
        return _limited(_listed(yaml.safe_load(read_text(path)), path))
    except yaml.YAMLError as e:
        raise InvalidConfig("rules", f"{path}: {e}") from e


def load_text_rules(path: str, score: float, title: str | None = None, description: str | None = None) -> list[Rule]:
    """A rule for each line that isn't blank; there are no comments."""
    out = []
    for line in read_text(path).splitlines():
        if pattern := line.strip():
            if len(pattern.encode()) > MAX_RULE_BYTES:
                raise TooLarge("rules", f"{path} has a line over {MAX_RULE_BYTES} bytes")
            out.append(Rule(title or Path(path).stem, description or path, pattern, score))
    return _limited(out)


def _limited(rules: list[Rule]) -> list[Rule]:
    if len(rules) > MAX_RULES:
        raise TooLarge("rules", f"over {MAX_RULES} rules")
    return rules


def load_rules(path: str, recursive: bool = True, score: float = 0.0, title: str | None = None, description: str | None = None) -> list[Rule]:
    """Rules of a file by its extension, or of all files of a folder in path order.

    JSON and YAML rules keep their own scores and titles, whatever is given here.
    """
    if os.path.isdir(path):
        files = sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs) if recursive else sorted(str(p) for p in Path(path).iterdir() if p.is_file())
        return _limited([r for f in files for r in load_rules(f, recursive, score, title, description)])
    if not os.path.isfile(path):
        raise InvalidConfig("rules", f"{path!r} doesn't exist")
    kind = Path(path).suffix.lower()
    if kind == ".json":
        return load_json_rules(path)
    if kind in (".yaml", ".yml"):
        return load_yaml_rules(path)
    return load_text_rules(path, score, title, description)


# --- alerts ---


@dataclass
class AlertMatcher:
    """Rules that name labels: the best score of the matching rules for each."""

    rules: list[Rule]

    @classmethod
    def load_json_file(cls, path: str) -> AlertMatcher:
        return cls(load_json_rules(path))

    def alerts(self, text: Column) -> Column:
        each = [F.when(text.rlike(java_pattern(r.match_rule)), F.struct(F.lit(r.title).alias("title"), F.lit(r.description).alias("description"), F.lit(float(r.score)).alias("score"), F.array(*map(F.lit, r.target_labels)).cast("array<string>").alias("labels"))) for r in self.rules]
        return F.filter(F.array(*each), lambda h: h.isNotNull()) if each else F.array().cast("array<struct<title:string,description:string,score:double,labels:array<string>>>")

    def classify_labels(self, docs: DataFrame) -> DataFrame:
        """(doc_id, label, score): by target label the largest score of the rules that match."""
        hit = docs.select("doc_id", F.explode(self.alerts(F.col("text"))).alias("h"))
        return hit.select("doc_id", F.explode("h.labels").alias("label"), F.col("h.score").alias("score")).groupBy("doc_id", "label").agg(F.max("score").alias("score"))

    def has_alerts(self, text: Column) -> Column:
        return F.size(self.alerts(text)) > 0

    def alert_titles(self, text: Column) -> Column:
        return self.titles(self.alerts(text))

    @staticmethod
    def titles(alerts: Column) -> Column:
        return F.transform(alerts, lambda h: F.concat(h["title"], F.lit(": "), h["description"]))


def max_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, label, score) of either table, the larger score where both have it."""
    return a.select("doc_id", "label", "score").unionByName(b.select("doc_id", "label", "score")).groupBy("doc_id", "label").agg(F.max("score").alias("score"))


def is_safe_pattern(pattern: str) -> bool:
    """No look-around and no back-reference: what a linear-time engine would take as well."""
    return not re.search(r"\(\?[=!<]|\\[1-9]", pattern)
