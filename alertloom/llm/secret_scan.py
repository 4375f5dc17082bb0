"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Positions are code points, ends exclusive. The patterns find assignments,
access keys and long hexadecimal strings. The entropy part looks at candidates:
maximal runs of 20 or more base64 characters with a digit. Each has a
character class (hexadecimal or base64) with its own threshold. A window of 20
characters slides over it; a character entering or leaving changes one count,
and with it the sum of c*log2(c), so the window's entropy is never computed
afresh. Overlapping windows above the threshold merge into a span. Candidates
that fit the allow-list are left out, as are spans within a pattern's span.

All of it is column expressions over one row: nothing is exchanged. Defined
results: a null or empty text has no spans; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored by
``scan_secrets`` and kept by ``redact_secrets``, whatever their names. The work
grows in proportion to a text's length and number of matches.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import checked_columns, sheltered

#: The three patterns, in the order of their kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST = 6

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
#: Bits a character by class, of at most log2(16) and log2(WINDOW).
THRESHOLDS = {"hex": 3.0, "base64": 3.7}
#: Candidates that are no secrets: UUIDs, numbers, lower-case paths and identifiers, placeholders.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^[0-9_/+=-]+$",
    r"^[a-z]++(?:[/_-][a-z]*+[0-9]{0,4}+)++$",
    r"(?i)example|sample|placeholder|abcdefghij|0123456789",
)
#: x*log2(x) in millionths, as whole numbers: sums of them stay exact.
XLOG = tuple(round(1e6 * x * log2(x)) if x else 0 for x in range(WINDOW + 1))
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Values that are handled in one fold, which copies what it has gathered at every step.
CHUNK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.transform(F.array(value), use)[0]


def before(amounts: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each whole number of an array, those in front of it merged (0 for the first).

    Values are appended within chunks, so the work grows in proportion to the array.
    """

    def scan(part: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(merge(acc["now"], x).alias("now"), F.array_append(acc["out"], acc["now"]).alias("out"))
        return F.aggregate(part, F.struct(start.cast("int").alias("now"), F.array().cast("array<int>").alias("out")), step)["out"]

    def from_chunks(chunks: Column) -> Column:
        wholes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), merge))
        return F.flatten(F.zip_with(chunks, scan(wholes, F.lit(0)), scan))

    return F.when(F.size(amounts) > 0, let(_chunks(amounts), from_chunks)).otherwise(F.array().cast("array<int>"))


def _chunks(values: Column) -> Column:
    count = F.floor((F.size(values) - 1) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), count), lambda k: F.slice(values, k * CHUNK + 1, CHUNK))


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, value) for every match of a pattern, leftmost and without overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def place(values: Column) -> Column:
        gaps = F.transform(F.slice(between, 1, F.size(values)), lambda gap: F.length(gap))
        wide = F.zip_with(gaps, values, lambda gap, value: gap + F.length(value))
        ends = lambda w: F.zip_with(before(w, lambda x, y: x + y), w, lambda x, y: x + y)
        return F.zip_with(let(wide, ends), values, lambda end, value: F.struct((end - F.length(value)).alias("start"), value.alias("value")))

    return F.when(F.size(found) > 0, let(found, place)).otherwise(F.array().cast("array<struct<start:int,value:string>>"))


def _spans(located: Column, kind: int) -> Column:
    return F.transform(located, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["value"])).alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start and kind."""
    assign = F.filter(_located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 1)) >= ASSIGN_LEAST)
    some = lambda token, spans: F.when(text.contains(token), spans).otherwise(F.array().cast(SPAN))
    return F.array_sort(F.concat(_spans(assign, 0), some("AKIA", _spans(_located(text, ACCESS), 1)), _spans(_located(text, HEX), 2)))


def _hot_runs(value: Column, threshold: Column) -> Column:
    """Merged windows (s, e) of a string whose entropy reaches a threshold, found by incremental counts."""
    table = F.array(*[F.lit(x) for x in XLOG])
    runs_type = "array<struct<s:int,e:int>>"
    limit = (F.lit(log2(WINDOW)) - threshold) * 1e6 * WINDOW

    def with_alphabet(chars: Column, alphabet: Column, table: Column) -> Column:
        places = F.transform(chars, lambda c: F.array_position(alphabet, c).cast("int"))

        def fold(place: Column, first: Column) -> Column:
            """Runs of the windows that start in the chunk at ``first``."""

            def step(acc: Column, i: Column) -> Column:
                full = i >= first + WINDOW
                enter = F.get(place, i) - 1
                leave = F.when(full, F.get(place, i - WINDOW) - 1).otherwise(-1)
                counts = F.transform(acc["counts"], lambda c, j: c + F.when(j == enter, 1).otherwise(0) - F.when(j == leave, 1).otherwise(0))
                more, less = F.get(acc["counts"], enter), F.get(acc["counts"], leave)
                change = F.when(enter == leave, 0).otherwise(
                    F.get(table, more + 1) - F.get(table, more) + F.when(full, F.get(table, less - 1) - F.get(table, less)).otherwise(0)
                )
                total = acc["total"] + change
                s, e = i - (WINDOW - 1), i + 1
                last = F.get(acc["runs"], F.size(acc["runs"]) - 1)
                joined = F.when(
                    last["e"] >= s,
                    F.array_append(F.slice(acc["runs"], 1, F.size(acc["runs"]) - 1), F.struct(last["s"].alias("s"), e.alias("e"))),
                ).otherwise(F.array_append(acc["runs"], F.struct(s.alias("s"), e.alias("e"))))
                runs = F.when((i >= first + (WINDOW - 1)) & (total <= limit), joined).otherwise(acc["runs"])
                return F.struct(counts.alias("counts"), total.alias("total"), runs.cast(runs_type).alias("runs"))

            zero = F.struct(
                F.transform(alphabet, lambda _: F.lit(0)).alias("counts"), F.lit(0).alias("total"), F.array().cast(runs_type).alias("runs")
            )
            upto = F.least(first + (CHUNK + WINDOW - 2), F.size(place) - 1)
            return F.aggregate(F.sequence(first, upto), zero, step)["runs"]

        def merged(runs: Column) -> Column:
            """Runs of successive chunks that touch become one."""
            begins = F.filter(runs, lambda r, i: (i == 0) | (r["s"] > F.get(runs, i - 1)["e"]))
            ends = F.filter(runs, lambda r, i: (i == F.size(runs) - 1) | (F.get(runs, i + 1)["s"] > r["e"]))
            return F.zip_with(begins, ends, lambda a, z: F.struct(a["s"].alias("s"), z["e"].alias("e")))

        chunks = lambda place: F.flatten(F.transform(F.sequence(F.lit(0), F.size(place) - WINDOW, F.lit(CHUNK)), lambda first: fold(place, first)))
        return let(let(places, chunks), merged)

    return let(F.split(value, ""), lambda chars: let(F.array_distinct(chars), lambda alphabet: let(table, lambda t: with_alphabet(chars, alphabet, t))))


def entropy_spans(text: Column) -> Column:
    """Spans of candidates' windows whose entropy is high for their character class."""
    allowed = lambda v: F.expr("false") if not ALLOWED else _any([v.rlike(p) for p in ALLOWED])
    candidates = F.filter(_located(text, CANDIDATE), lambda x: ~allowed(x["value"]))
    threshold = lambda v: F.when(v.rlike("^[0-9a-fA-F]+$"), THRESHOLDS["hex"]).otherwise(THRESHOLDS["base64"])
    runs = F.transform(
        candidates,
        lambda x: F.transform(
            _hot_runs(x["value"], threshold(x["value"])),
            lambda r: F.struct((x["start"] + r["s"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + r["e"]).alias("end")),
        ),
    )
    return F.when(text.rlike("[0-9]"), F.flatten(runs)).otherwise(F.array().cast(SPAN))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _with_spans(docs: DataFrame) -> DataFrame:
    """Adds "base spans" and "all spans": arrays of (start, kind, end), sorted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("*", base_spans(text).alias("base spans"), entropy_spans(text).alias("more spans"))
    both = F.array_sort(F.concat("base spans", "more spans"))

    def visible(spans: Column) -> Column:
        # An entropy span lies within a pattern's span if one of those in front of it ends no earlier.
        reach = before(F.transform(spans, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        return let(reach, lambda held: F.filter(spans, lambda x, i: (x["kind"] < 3) | (x["end"] > F.get(held, i))))

    every = F.when(F.size("more spans") > 0, let(both, visible)).otherwise(F.col("base spans"))
    return found.withColumn("all spans", every).drop("more spans")


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans for every document."""
    found = _with_spans(checked_columns(docs, "doc_id", "text"))
    count = lambda k: F.size(F.filter("all spans", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined("base spans"), 256).alias("base_sha256"),
        _joined("all spans").alias("spans"),
    )


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by ``[kind]``; of overlapping spans, their union by the first kind.

    A column n_chars, where there is one, is brought up to date. Other columns
    and all names stay as they are.
    """
    counted = [c for c in docs.columns if c.lower() == "n_chars"][:1]
    held, restore = sheltered(docs, "text", *counted)
    names = F.array(*[F.lit(k) for k in KINDS])

    def clean(spans: Column, reach: Column, chars: Column) -> Column:
        """The text in between, and the kind, for every span that starts a union; the rest of the text."""
        cut = lambda low, high: F.array_join(F.slice(chars, low + 1, high - low), "")
        pieces = F.transform(
            spans,
            lambda x, i: let(F.get(reach, i), lambda at: F.when(x["start"] >= at, F.concat(cut(at, x["start"]), F.lit("["), F.get(names, x["kind"]), F.lit("]"))).otherwise("")),
        )
        last = F.greatest(F.element_at(reach, -1), F.element_at(spans, -1)["end"])
        return F.concat(F.array_join(pieces, ""), cut(last, F.size(chars)))

    reach = before(F.transform("all spans", lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    fresh = let(reach, lambda r: let(F.split("text", ""), lambda chars: clean(F.col("all spans"), r, chars)))
    redacted = _with_spans(held).withColumn("text", F.when(F.size("all spans") > 0, fresh).otherwise(F.col("text")))
    for name in counted:
        redacted = redacted.withColumn(name, F.when(F.size("all spans") > 0, F.length("text").cast(docs.schema[name].dataType)).otherwise(F.col(name)))
    return restore(redacted)
