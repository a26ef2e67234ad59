"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived: what every match must contain.  The postings of those
trigrams are written as an index, intersected per document, and the rules' regexes run only on the documents that the
index leaves.  A rule whose regex has no mandatory trigram is run on every document.
"""

from __future__ import annotations

import re._parser as regex_tree
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.llm.words import new_name
from sitegauge.session import small_table, stage

MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` uses syntax common to Java and Python.  Matches shorter than ``least`` are dropped: the whole match, or
    its group ``counted``."""

    kind: str
    pattern: str
    least: int = 0
    counted: int = 0


# A PEM key runs to its end line, over whatever holds no five dashes, such as quotes, escaped line ends and headers.
# Where that line is missing, it runs over the base64 lines that follow.  Repeats of groups are bounded, as Java's matcher
# calls itself for each, and those inside one another multiply to less than 1000, the most that SQL's matcher takes.
BASE64, BETWEEN = "[A-Za-z0-9+/=]", r"""[\x09-\x0D\x20"'>#*|,+]*(?:\\[nrt][\x09-\x0D\x20"'>#*|,+]*){0,3}"""
MORE_LINES = rf"(?:{BETWEEN}{BASE64}{{16,}}){{0,60}}"
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:[^-]*(?:-{1,4}[^-]+){0,240}-{5,}END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{BETWEEN}(?:Proc-Type|DEK-Info):[^\x0A\x0D\\]*){{0,2}}"
    rf"{BETWEEN}{BASE64}{{40,}}{MORE_LINES * 4}(?:(?:\\[nr]|[\x0A\x0D\x20]){{1,4}}{BASE64}{{1,15}})?)?")

# The three given rules, then token formats that their issuers publish.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),  # the runs of [0-9a-f]+ that are long enough
)
MORE_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("private_key", PRIVATE_KEY),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


def _strings(items) -> set[str] | None:
    """All strings (lower case) that a part of a regex can match, or None if they are many."""
    found = {""}
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            step = {chr(value).lower()}
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in value):
            codes = [c for o, v in value for c in ([v] if str(o) == "LITERAL" else range(v[0], v[1] + 1))]
            step = {chr(c).lower() for c in codes} if len(codes) <= 8 else None
        elif name == "SUBPATTERN":
            step = _strings(value[3])
        elif name == "BRANCH":
            parts = [_strings(x) for x in value[1]]
            step = None if None in parts else set().union(*parts)
        elif name == "MAX_REPEAT" and value[1] <= 4:
            one = _strings(value[2])
            step = None if one is None else {
                "".join(x) for n in range(value[0], value[1] + 1) for x in product(sorted(one), repeat=n)}
        else:
            step = None
        if step is None or len(found) * len(step) > MAX_STRINGS:
            return None
        found = {a + b for a in found for b in step}
    return found


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """What any match must contain, as an OR of ANDs of lower-case trigrams; None if nothing is mandatory.

    The regex is read as a sequence.  Neighbouring parts that can match only a few strings are put together; each such
    stretch demands the trigrams of one of its strings.
    """
    stretches, current = [], {""}

    def close() -> None:
        nonlocal current
        if all(len(s) >= 3 for s in current):
            stretches.append({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in current})
        current = {""}

    def read(items) -> None:
        nonlocal current
        for item in items:
            step = _strings([item])
            if step is not None and len(current) * len(step) <= MAX_STRINGS:
                current = {a + b for a in current for b in step}
                continue
            op, value = str(item[0]), item[1]
            if op == "SUBPATTERN":
                read(value[3])
            else:
                close()
                if op == "MAX_REPEAT" and value[0] >= 1:
                    read(value[2])
                    close()

    read(regex_tree.parse(pattern))
    close()
    if not stretches:
        return None
    whole = stretches[0]
    for more in stretches[1:]:
        if len(whole) * len(more) <= MAX_STRINGS:
            whole = {a | b for a in whole for b in more}
    # A clause that asks for more than another adds nothing to the OR.
    return sorted((c for c in whole if not any(d < c for d in whole)), key=sorted)


def postings(docs: DataFrame, trigrams: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """(``trigram``, ``id``) for the asked trigrams that occur in a text, without regard to case."""
    wanted = F.array(*[F.lit(t) for t in trigrams])
    present = F.transform(F.array(F.lower(F.col(text_col))), lambda t: F.filter(wanted, lambda g: F.contains(t, g)))[0]
    return docs.where(F.col(text_col).isNotNull()).select(F.explode(present).alias("trigram"), F.col(id_col).alias("id"))


def candidates(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id``, ``kinds``): the rules that the index cannot rule out, one row per id that has any."""
    clauses = []
    for rule in rules:
        for number, clause in enumerate(trigram_query(rule.pattern) or ()):
            grams = sorted(clause)[:62]
            clauses += [(g, rule.kind, number, 1 << i, (1 << len(grams)) - 1) for i, g in enumerate(grams)]
    spark = docs.sparkSession
    asked = small_table(spark, clauses, "trigram string, kind string, clause int, bit bigint, all_bits bigint")
    index = stage(postings(docs, sorted({c[0] for c in clauses}), id_col, text_col).sortWithinPartitions("trigram"), "postings")
    met = index.join(F.broadcast(asked), "trigram").groupBy("id", "kind", "clause", "all_bits").agg(
        F.bit_or("bit").alias("bits")).where("bits = all_bits")
    return met.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def matches(text: Column, rule: Rule, number: int) -> Column:
    """All spans of a rule: struct(start, number, end, kind), in code points; leftmost, not overlapping.

    Each match is taken together with the gap before it, so the lengths of gaps and matches add up to the places.
    """
    whole = r"(?s)\G(.*?)(" + rule.pattern + ")"
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(group)), F.length)
    counted = lengths(2 + rule.counted) if rule.counted else lengths(2)
    pieces = F.arrays_zip(lengths(1).alias("gap"), lengths(2).alias("n"), counted.alias("least"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        begin = state["at"] + piece["gap"]
        span = F.struct(begin.alias("start"), F.lit(number).alias("number"), (begin + piece["n"]).alias("end"),
                        F.lit(rule.kind).alias("kind"))
        return F.struct((begin + piece["n"]).alias("at"), F.when(
            piece["least"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(pieces, start, step)["spans"]


def with_spans(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text",
               out: str = "spans") -> DataFrame:
    """All rows and columns of ``docs`` and ``out``: its spans by start, then in the rules' order.

    A null or empty text has no spans.  Rows with equal or null ids are searched each on its own text; the index only
    decides which rules are tried.  An empty table stays empty.
    """
    of, listed = new_name(docs, "candidate"), new_name(docs, "kinds")
    kinds = stage(candidates(docs, rules, id_col, text_col), "candidates").select(F.col("id").alias(of), F.col("kinds").alias(listed))
    # Built from the few candidates, so that the texts are shuffled once and not sorted.
    tried = docs.join(kinds.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(of)), "left")
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    found = []
    for number, rule in enumerate(rules):
        if trigram_query(rule.pattern) is None:
            try_it = F.col(text_col).rlike(rule.pattern)
        else:
            try_it = F.array_contains(listed, rule.kind)
        found.append(F.when(try_it, matches(F.col(text_col), rule, number)).otherwise(none))
    spans = F.array_sort(F.concat(*found))
    return tried.withColumn(out, F.when(F.col(text_col).isNull(), none).otherwise(spans)).drop(of, listed)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base rules' spans and all spans as text, for every row."""
    found = with_spans(docs.select(id_col, text_col), RULES, id_col, text_col, "_spans")
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)
    base = F.filter("_spans", lambda s: s["number"] < len(BASE_RULES))
    return found.select(id_col, *[count(r.kind) for r in BASE_RULES], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with every span, overlapping ones together, replaced by its kind in brackets; other columns stay, whatever
    their names."""
    spans = new_name(docs, "spans")
    found = with_spans(docs, rules, id_col, text_col, spans)
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        fresh = F.concat(state["out"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit("["),
                         span["kind"], F.lit("]"))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"),
                        F.when(span["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"))

    clean = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).select(*docs.columns)
