"""Knapsack word problems: rendering, and extraction of items, capacity and budget."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.operators.hashing import ITEMS

#: Terms that a neutral question may not hold.
LEAKAGE_TERMS = (
    "compact", "arc-flow", "arc flow", "dp-flow", "dp flow", "set cover", "set-cover", "set partition", "qubo", "dynamic programming",
    "branch and bound", "fptas", "greedy", "0-1 knapsack", "0/1 knapsack", "knapsack formulation",
)
#: Phrases before the capacity, in the order in which they are tried.
CAPACITY_PHRASES = (
    r"(?:maximum\s+)?weight\s+capacity\s+of", r"capacity\s+of", r"weight\s+capacity\s+of", r"capacity\s+limit\s+of", r"maximum\s+capacity\s+of",
    r"must\s+not\s+exceed", r"does\s+not\s+exceed", r"budget[^\n]*?is", r"no\s+more\s+than", r"total\s+weight\s+capacity[^\n]*?is",
    r"total\s+(?:workload|weight)\s+capacity[^\n]*?(?:is|limited to)", r"weight\s+limit[^\n]*?is",
)
NUMBER = r"(\d[\d,]*)"
#: What items are called.
ITEM_WORDS = "Item Package Shipment Equipment Supply Cargo Product Component Crop Resource Project Candidate Material Food".split()
KW = "(?:" + "|".join(ITEM_WORDS) + ")"
#: Header words of table columns. In item tables value and weight; in cost tables the roles differ.
ITEM_TABLE = {"weight": ("weight", "cost"), "profit": ("value", "profit", "benefit", "revenue")}
COST_TABLE = {"weight": ("cost", "expense", "price", "weight"), "profit": ("capacity", "increase", "saving", "benefit", "value", "profit", "return")}


def render(instances: DataFrame) -> DataFrame:
    """Adds the neutral question; raises if it holds a formulation term."""
    n = F.size("weights").cast("string")
    capacity = F.col("capacity").cast("string")
    lines = F.array_join(F.transform(F.arrays_zip("weights", "profit"), lambda x, i: F.concat(F.lit("- Item "), i.cast("string"), F.lit(": Value = "), x["profit"].cast("string"), F.lit(", Weight = "), x["weights"].cast("string"))), "\n")
    parts = [
        F.lit("# Question"), F.lit(""), F.concat(F.lit("Consider a selection problem with "), n, F.lit(" items and a capacity of "), capacity, F.lit(".")),
        F.lit("Each item has a value and a weight."), F.lit("The total weight of selected items must not exceed the capacity."),
        F.lit("Maximize the total value of selected items."), F.lit("Each item can either be fully selected or not selected at all."), F.lit(""),
        F.concat(F.lit("Number of items: "), n), F.concat(F.lit("Capacity: "), capacity), F.lit("Item details:"), lines, F.lit(""),
        F.lit("Return a mathematical optimization model and executable Python solver code."),
    ]
    rows = instances.withColumn("question", F.concat_ws("\n", *parts)).withColumn("__lowered", F.lower("question"))
    leaks = leaked_terms(F.col("question"))
    clean = ~reduce(or_, (F.contains("__lowered", F.lit(t)) for t in LEAKAGE_TERMS))
    return rows.withColumn("question", F.when(clean, F.col("question")).otherwise(F.raise_error(F.concat(F.lit("question leaks "), F.array_join(leaks, ","))).cast("string"))).drop("__lowered")


def leaked_terms(question: Column) -> Column:
    lowered = F.lower(question)
    return F.filter(F.array(*map(F.lit, LEAKAGE_TERMS)), lambda t: F.contains(lowered, t))


def prepared(question: Column) -> Column:
    """Without bold marks, with plain dollar signs, cut at the note."""
    return F.substring_index(F.replace(F.replace(question, F.lit("**"), F.lit("")), F.lit("\\$"), F.lit("$")), "# Note:", 1)


def plain_number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).cast("long")


def capacity_of(text: Column) -> Column:
    """By the first phrase that occurs; else the budget."""
    budget = r"budget\s+of"
    found = [F.nullif(F.regexp_extract(text, rf"(?Ui){p}\s*{NUMBER}", 1), F.lit("")) for p in (*CAPACITY_PHRASES, budget)]
    plain = [F.nullif(F.regexp_extract(F.lower(text), rf"{p}\s*{NUMBER}", 1), F.lit("")) for p in (*CAPACITY_PHRASES, budget)]
    return plain_number(F.when(is_plain(text), F.coalesce(*plain)).otherwise(F.coalesce(*found)))


def is_plain(text: Column) -> Column:
    """ASCII without control characters but white space: in lower case it is searched by lower-cased patterns without flags."""
    return ~F.rlike(text, F.lit(r"[^\t-~]"))


def parse_rendered(questions: DataFrame) -> DataFrame:
    """(instance_id, weights, profit, capacity) of questions in the ``Item N: Value = X, Weight = Y`` form, without Python.

    Plain texts are searched once: each match is replaced by its groups between marks.
    """
    text = F.col("__text")
    pattern = rf"(?:\d+\.\s*)?{KW}\s*(\d+)\s*:?\s*Value\s*=\s*{NUMBER}.*?Weight\s*=\s*{NUMBER}"
    group = lambda i: F.regexp_extract_all(text, F.lit(f"(?Ui){pattern}"), F.lit(i))
    starts = "".join(sorted({w[0].lower() for w in ITEM_WORDS}))
    marked = F.split(F.regexp_replace(F.lower(text), rf"(?=[0-9{starts}]){pattern.lower()}", "\1$1\2$2\2$3\1"), "\1")
    part = lambda x, i: F.split_part(x, F.lit("\2"), F.lit(i))
    match = lambda n, p, w, i: F.struct(n.cast("long").alias("n"), i.alias("i"), plain_number(p).alias("p"), plain_number(w).alias("w"))
    once = F.transform(F.filter(marked, lambda _, i: i % 2 == 1), lambda x, i: match(part(x, 1), part(x, 2), part(x, 3), i))
    other = F.transform(F.arrays_zip(group(1).alias("n"), group(2).alias("p"), group(3).alias("w")), lambda x, i: match(x["n"], x["p"], x["w"], i))
    rows = questions.withColumn("__text", prepared(F.col("question")))
    rows = rows.withColumn("__items", F.sort_array(F.when(is_plain(text), once).otherwise(other))).withColumn("capacity", capacity_of(text))
    return rows.select("instance_id", F.transform("__items", lambda x: x["w"]).alias("weights"), F.transform("__items", lambda x: x["p"]).alias("profit"), "capacity")


def number(text: str) -> int:
    return int(text.replace(",", ""))


_NUM = r"(\d[\d,]*)"
_SEP = r"[\s_]*"
#: The written forms of item lists, in the order in which they are tried, with what their groups are: n the item's number or letter, p its profit, w its weight.
FORMS = [
    ("npw", rf"(?:\d+\.\s*)?{KW}\s*(\d+)\s*:?\s*Value\s*=\s*{_NUM}.*?Weight\s*=\s*{_NUM}"),
    ("nwp", rf"(?:\d+\.\s*)?{KW}\s*(\d+)\s*:?\s*Weight\s*=\s*{_NUM}.*?Value\s*=\s*{_NUM}"),
    ("npw", rf"{KW}\s*(\d+|[A-Z])\s+has an?\s+(?:educational\s+)?(?:value|utility)\s+of\s*{_NUM}.*?(?:and\s+)?(?:weighs|a weight of|weight of|costs)\s*{_NUM}"),
    ("npw", rf"`?item_(\d+)`?\s*\(\s*value\s*[:= ]\s*{_NUM}.*?weight\s*[:= ]\s*{_NUM}\s*\)"),
    ("npw", rf"`?item_(\d+)`?\s*:?\s*Value\s*=\s*{_NUM}.*?Weight\s*=\s*{_NUM}"),
    ("npw", rf"item_(\d+).*?has a value of\s*{_NUM}.*?weighs\s*{_NUM}"),
    ("npw", rf"item_(\d+)\s+is valued at\s*{_NUM}.*?weighs\s*{_NUM}"),
    ("npw", rf"{KW}{_SEP}(\d+|[A-Z])\s*:?\s*Valued at\s*{_NUM}.*?(?:weighing|weighs)\s*{_NUM}"),
    ("npw", rf"{KW}\s*(\d+)\s*:?\s*Valued at\s*{_NUM}.*?with a cost of\s*{_NUM}"),
    ("npw", rf"{KW}\s*(\d+)\s*:?\s*(?:Value|Utility|Benefit|Performance)\s+of\s*{_NUM}.*?(?:weight|cost)\s+of\s*{_NUM}"),
    ("npw", rf"{KW}\s*(\d+)\s+has a value of\s*{_NUM}.*?and a cost of\s*{_NUM}"),
    ("npw", rf"{KW}\s*(\d+)\s+has a value of\s*{_NUM}.*?and a weight of\s*{_NUM}"),
    ("npw", rf"{KW}\s*(\d+)\s+with a value of\s*{_NUM}.*?and weight of\s*{_NUM}"),
    ("npw", rf"{KW}\s*(\d+)\s*:?\s*(?:This\s+\w+\s+)?(?:Has|Provides|Contributes)\s+an?\s+(?:value|utility|educational value|performance)\s+of\s*{_NUM}.*?(?:and\s+)?(?:weighs|costs|adds a workload of|with a weight of)\s*{_NUM}"),
    ("npw", rf"{KW}\s*(\d+)\s*:?\s*Valued at\s*{_NUM}.*?with a weight of\s*{_NUM}"),
    ("npw", rf"{KW}\s*(\d+|[A-Z])\s*:?\s*\n\s*[-*]\s*Value\s*:\s*\$?\s*{_NUM}.*?\n\s*[-*]\s*Weight\s*:\s*\$?\s*{_NUM}"),
]
#: Separate lists of profits and of weights, and their lines.
SECTIONS = {
    "profit": (r"(?:Value|Revenue|Profit)[^\n:]*:\s*\n(.*?)(?=\n\s*(?:[-*]\s*)?(?:Weight|Objective|Constraint|Decision|Your|$))", rf"{KW}\s*(\d+)\s*:?\s*\$?\s*{_NUM}"),
    "weight": (r"Weight[^\n:]*:\s*\n(.*?)(?=\n\s*(?:[-*]\s*)?(?:Objective|Constraint|Decision|Your|$))", rf"{KW}\s*(\d+)\s*:?\s*{_NUM}"),
}
#: Lines of units of each, anywhere in the text, and the line under a table's header.
UNIT_LINES = {side: rf"{KW}\s*(\d+)\s*:\s*{_NUM}\s*units of {word}" for side, word in (("profit", "value"), ("weight", "weight"))}
TABLE_RULE = re.compile(r"\s*\|[\s\-:|]+\|\s*$")
#: What a lower-cased text must hold for each of the FORMS to match anywhere: their literal parts.
NEEDED = [
    ("value", "weight", "="), ("value", "weight", "="), ("has a", "of"), ("item_", "(", "value", "weight", ")"), ("item_", "value", "weight", "="), ("item_", "has a value of", "weighs"), ("item_", "is valued at", "weighs"), ("valued at", "weigh"),
    ("valued at", "with a cost of"), ("of",), ("has a value of", "and a cost of"), ("has a value of", "and a weight of"), ("with a value of", "and weight of"), ("of",), ("valued at", "with a weight of"), ("value", "weight", ":", "\n"),
]


@cache
def compiled(pattern: str, plain: bool, flags: re.RegexFlag = re.NOFLAG) -> re.Pattern:
    """The pattern in any case; for ``plain`` text, ASCII in lower case, in lower case, which is searched much faster."""
    return re.compile(pattern.lower(), flags) if plain else re.compile(pattern, re.IGNORECASE | flags)


def from_form(text: str, groups: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    """(weight, profit) of a form's matches by number; letters count by their code."""
    rows = [dict(zip(groups, m.groups(), strict=True)) for m in pattern.finditer(text)]
    rows.sort(key=lambda r: int(r["n"]) if r["n"].isdigit() else ord(r["n"].upper()))
    return [(number(r["w"]), number(r["p"])) for r in rows]


def joined_lists(found: dict[str, list[tuple[str, str]]]) -> list[tuple[int, int]]:
    """Lists of profits and of weights joined by item number, if two items or more have both."""
    profit, weight = ({int(n): number(v) for n, v in found[side]} for side in ("profit", "weight"))
    common = sorted(profit.keys() & weight.keys())
    return [(weight[i], profit[i]) for i in common] if len(common) >= 2 else []


def from_sections(text: str, plain: bool = False) -> list[tuple[int, int]]:
    found = {}
    for side, (section, line) in SECTIONS.items():
        m = compiled(section, plain, re.DOTALL).search(text)
        found[side] = compiled(line, plain).findall(m.group(1)) if m else []
    return joined_lists(found)


def from_unit_lines(text: str, plain: bool = False) -> list[tuple[int, int]]:
    if plain and "units of value" not in text:
        return []
    return joined_lists({side: compiled(line, plain).findall(text) for side, line in UNIT_LINES.items()})


def from_table(text: str, words: dict[str, tuple[str, ...]]) -> list[tuple[int, int]]:
    """The first markdown table, if its header (three cells or more) names both columns and two rows or more have both; it ends at a line without a bar."""
    lines = text.split("\n")
    rule = next((i for i, line in enumerate(lines) if TABLE_RULE.match(line)), 0)
    if not rule:
        return []
    cells = lambda line: [c.strip() for c in line.split("|")[1:-1]]
    head = [c.lower() for c in cells(lines[rule - 1])]
    at = {side: next((i for i, c in enumerate(head) if any(w in c for w in names)), None) for side, names in words.items()}
    if len(head) < 3 or None in at.values() or at["weight"] == at["profit"]:
        return []
    out = []
    for line in map(str.strip, lines[rule + 1 :]):
        if not line.startswith("|"):
            break
        row = cells(line)
        values = [re.search(_NUM, row[at[s]]) if len(row) > max(at.values()) else None for s in ("weight", "profit")]
        if all(values):
            out.append((number(values[0][1]), number(values[1][1])))
    return out if len(out) >= 2 else []


def parse_items(text: str) -> list[tuple[int, int]]:
    """(weight, profit) by the first form that finds anything.

    ASCII text is lower-cased first, and forms whose literal parts it lacks are not tried.
    """
    if plain := text.isascii():
        text = text.lower()
    for (groups, pattern), needed in zip(FORMS, NEEDED, strict=True):
        if plain and not all(x in text for x in needed):
            continue
        if found := from_form(text, groups, compiled(pattern, plain)):
            return found
    return from_sections(text, plain) or from_unit_lines(text, plain) or from_table(text, ITEM_TABLE) or from_table(text, COST_TABLE)


def parse_questions(questions: DataFrame) -> DataFrame:
    """(instance_id, weights, profit, capacity, parsed): every written form; parsed says if the result is valid.

    Preparation and the capacity are expressions; only the many forms of item lists run
    in Python, on Arrow batches.
    """
    rows = questions.select("instance_id", prepared(F.col("question")).alias("text"), capacity_of(prepared(F.col("question"))).alias("capacity"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [parse_items(t) if t else [] for t in f.text]
            yield pd.DataFrame({"instance_id": f.instance_id, "weights": [[w for w, _ in x] for x in found], "profit": [[p for _, p in x] for x in found], "capacity": f.capacity.astype("Int64")})

    out = rows.mapInPandas(run, "instance_id string, weights array<bigint>, profit array<bigint>, capacity bigint")
    sound = F.size("weights").between(*ITEMS) & F.forall("weights", lambda w: w > 0) & F.forall("profit", lambda p: p >= 0) & (F.col("capacity") > 0)
    return out.withColumn("parsed", F.coalesce(sound, F.lit(False)))
