"""Rule evaluation: a catalogue of predicates, all evaluated in one pass over their subjects.

A rule is a row of the catalogue with a predicate over columns. Evaluation builds
one array of the rules that fire and explodes it, so a corpus is read once however
many rules there are, and no subject is joined with the catalogue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    key: str
    severity: str
    category: str
    message: str
    holds: Callable[[], Column]


def _matches(pattern: str, held: str = "", column: str = "text") -> Callable[[], Column]:
    """Whether the pattern matches; `held` is a plain part of all that does, looked for first as that is cheap."""
    return lambda: F.col(column).contains(held) & F.col(column).rlike(pattern) if held else F.col(column).rlike(pattern)


def _has(every: Iterable[str] = (), none: Iterable[str] = (), some: Iterable[str] = (), column: str = "body") -> Callable[[], Column]:
    """All of `every`, none of `none`, and one of `some` if there are any, as plain substrings."""

    def build() -> Column:
        out = F.lit(True)
        for token in every:
            out &= F.col(column).contains(token)
        for token in none:
            out &= ~F.col(column).contains(token)
        if some := tuple(some_):
            one = F.lit(False)
            for token in some:
                one |= F.col(column).contains(token)
            out &= one
        return out

    every, none, some_ = tuple(every), tuple(none), tuple(some)
    return build


#: Rules over prose documents.
DOCUMENT_RULES = (
    Rule("DOC-LONG", "MAJOR", "CODE_SMELL", "Text is long", lambda: F.col("n_chars") > 5000),
    Rule("DOC-SHOUT", "CRITICAL", "BUG", "Text shouts", _matches("[A-Z]{6,}!!", "!!")),
    Rule("DOC-SECRET", "CRITICAL", "SECURITY", "Text holds a secret", _matches('(token|password|secret|api_key) = "', ' = "')),
    Rule("DOC-EMAIL", "MAJOR", "SECURITY", "Text holds a mail address", _matches("[a-z0-9.]+@[a-z0-9]+[.][a-z]+", "@")),
    Rule("DOC-LICENSE", "INFO", "DESIGN", "Text holds a licence line", _matches("[Ll]icensed under", "icensed under")),
    Rule("DOC-TABLE", "MINOR", "CODE_SMELL", "Text is a table", _matches(" [|] [^|]+ [|] ", " | ")),
    Rule("DOC-SHORT", "MINOR", "CODE_SMELL", "Text is short", lambda: F.col("n_chars") < 200),
    Rule("DOC-NUMBER", "MINOR", "PERFORMANCE", "Text holds a long number", _matches("[0-9]{12,}")),
)


def evaluate(subjects: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """The subjects' columns with rule_key, severity, category, message and seq, a row for each rule that fires."""
    fired = [F.when(r.holds(), F.struct(F.lit(r.key).alias("rule_key"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.lit(r.message).alias("message"), F.lit(i).alias("seq"))) for i, r in enumerate(rules)]
    return subjects.withColumn("_fired", F.explode(F.array_compact(F.array(*fired)))).select(*subjects.columns, "_fired.*")


def first_of_key(issues: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return issues.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def applicable(annotations: Column, family: str) -> Column:
    """Whether a family of rules looks at a class with these annotations."""
    wanted = {"SPRING": "Controller|Service|Component|Repository|RestController", "DATABASE": "Repository|Mapper|Entity|Table", "WEB": "Controller|RestController|RequestMapping"}.get(family)
    return F.lit(True) if wanted is None else F.exists(annotations, lambda a: a.rlike(wanted))
