"""Token, text and parsing expressions over alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BENIGN = "false_positive"


def clean(value: Column) -> Column:
    """Trimmed string; blank is null."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def epoch_seconds(value: Column) -> Column:
    """A numeric-looking value as whole seconds, truncated; null where it is none."""
    return value.cast("string").try_cast("double").cast("bigint")


def alert_id(scenario: Column | str, *fields: Column) -> Column:
    """SHA-1 of scenario and fields, joined by bars; null fields are empty."""
    first = F.lit(scenario) if isinstance(scenario, str) else scenario
    return F.sha1(F.concat_ws("|", first, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))


def pregrouped_id(signature_id: Column, ext_ip: Column, int_ip: Column, timestamp: Column) -> Column:
    """SHA-1 of a pre-grouped row's key; a missing internal address counts as -1."""
    return F.sha1(F.concat_ws("|", signature_id.cast("string"), ext_ip, F.coalesce(int_ip, F.lit("-1")), timestamp.cast("string")))


def normalize_text(text: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def short_tokens(short: Column) -> Column:
    """Distinct trimmed parts between hyphens."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(short, F.lit("")), "-"), lambda x: F.trim(x)), lambda x: x != ""))


def signature_tokens(signature: Column, allowed: list[str], blocked: list[str]) -> Column:
    """Distinct lower-case letter runs that are allowed and not blocked."""
    found = F.regexp_extract_all(F.lower(F.coalesce(signature, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    return F.array_intersect(found, F.array(*[F.lit(x) for x in allowed if x not in set(blocked)]).cast("array<string>"))


def feature_tokens(short: Column, host: Column, signature: Column) -> Column:
    """Sorted distinct ``short:``, ``host:`` and ``sig:`` tokens; addresses are left out on purpose."""
    tag = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}:"), value))
    every = F.concat(F.array(tag("short", clean(short)), tag("host", clean(host))), F.transform(signature, lambda t: F.concat(F.lit("sig:"), t)))
    return F.array_sort(F.array_distinct(F.array_compact(every)))


def parse_signature(text: Column) -> dict[str, Column]:
    """Rule set, category and rest of a signature line; no match leaves the first two empty."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[^\]]*\]", ""))
    shape = r"^(ETPRO|ET|GPL)\s+([A-Z_]+)\s+(.*)$"
    rest = F.regexp_extract(bare, shape, 3)
    return {"ruleset": F.regexp_extract(bare, shape, 1), "category": F.regexp_extract(bare, shape, 2), "description": F.when(bare.rlike(shape), rest).otherwise(bare)}


def cve_refs(text: Column) -> Column:
    """Sorted distinct CVE identifiers, upper-cased."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\bCVE-\d{4}-\d+\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def content_tokens(text: Column, noise: list[str], short_ok: list[str]) -> Column:
    """Words of a normalised text without noise, numbers, single letters and unlisted pairs; neighbours that repeat collapse."""
    words = F.split(normalize_text(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\bCVE-\d{4}-\d+\b", " ")), " ")
    fits = lambda w: ~w.isin(*noise, "") & ~w.rlike("^[0-9]+$") & (F.length(w) > 1) & ((F.length(w) != 2) | w.isin(*short_ok, ""))
    kept = F.filter(words, fits)
    return F.transform(F.array(kept), lambda a: F.filter(a, lambda w, i: (i == 0) | (w != F.get(a, i - 1))))[0]


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by an underscore."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def abstract_mail_hosts(tokens: Column) -> Column:
    """``host:*_mail`` becomes ``host:mail_host``; two or more of them add ``host:multiple_mail_hosts``."""
    is_mail = lambda t: t.startswith("host:") & t.endswith("_mail")
    several = F.size(F.array_distinct(F.filter(tokens, is_mail))) >= 2
    plain = F.transform(tokens, lambda t: F.when(is_mail(t), "host:mail_host").otherwise(t))
    return F.array_sort(F.array_distinct(F.when(several, F.array_append(plain, F.lit("host:multiple_mail_hosts"))).otherwise(plain)))


def abstract_by_map(tokens: Column, hierarchy: dict[str, list[str]], level: int, keep_unmapped: bool = True) -> Column:
    """Replace tokens by their ancestor at a level of ``hierarchy`` (specific first), then drop ancestors of tokens that stay."""
    pairs = [x for k, v in hierarchy.items() for x in (F.lit(k), F.lit(v[min(level, len(v) - 1)]))]
    mapping = F.create_map(*pairs)
    fresh = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(mapping, t), t if keep_unmapped else F.lit(None).cast("string")))
    distinct = F.array_distinct(F.array_compact(fresh))
    above: dict[str, list[str]] = {}
    for chain in hierarchy.values():
        for i, item in enumerate(chain[:-1]):
            above.setdefault(item, []).extend(chain[i + 1 :])
    if not above:
        return distinct
    parents = F.create_map(*[x for k, v in above.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in dict.fromkeys(v)]))])
    return F.array_except(distinct, F.flatten(F.transform(distinct, lambda t: F.coalesce(F.try_element_at(parents, t), F.array().cast("array<string>")))))


def run_lengths(tokens: Column, mark: str = "__repeat_") -> Column:
    """Run-length encoding: a run of 2, of 3 or 4, of 5 or more gets ``2``, ``3_4`` or ``5_plus`` behind the mark."""
    zero = F.array().cast("array<struct<t:string,n:int>>")

    def step(acc: Column, t: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(last["t"].alias("t"), (last["n"] + 1).alias("n")))
        return F.when(last["t"] == t, longer).otherwise(F.array_append(acc, F.struct(t.alias("t"), F.lit(1).alias("n"))))

    show = lambda x: F.when(x["n"] == 1, x["t"]).otherwise(F.concat(x["t"], F.lit(mark), F.when(x["n"] == 2, "2").when(x["n"] <= 4, "3_4").otherwise("5_plus")))
    return F.aggregate(tokens, zero, step, lambda acc: F.transform(acc, show))


def decode_runs(text: Column) -> Column:
    """Without run marks."""
    return reduce(lambda c, m: F.replace(c, F.lit(m), F.lit("")), ("__repeat_2", "__repeat_3_4", "__repeat_5_plus"), text)


def sanitize(token: Column) -> Column:
    """A token as part of a column name."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.replace(token, F.lit(":"), F.lit("_")), r"[^0-9A-Za-z_]+", "_"), "^_+|_+$", ""))


def feature_name(items: Column) -> Column:
    return F.concat(F.lit("sym__"), F.array_join(F.transform(items, sanitize), "__"))


def or_feature_name(clauses: Column) -> Column:
    return F.concat(F.lit("or__"), F.array_join(F.transform(clauses, lambda c: F.array_join(F.transform(c, sanitize), "_")), "__OR__"))


def text_column(fields: dict[str, Column]) -> Column:
    """``Key: value | Key: value`` over the fields that are not null."""
    return F.concat_ws(" | ", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields.items()])


def parse_reply(reply: Column) -> Column:
    """1 for a reply that names attack only, 0 for benign only, else null."""
    upper = F.upper(F.coalesce(reply, F.lit("")))
    attack, benign = upper.contains("ATTACK"), upper.contains("BENIGN")
    return F.when(attack & ~benign, 1).when(benign & ~attack, 0)


def join_step(items: Column) -> Column:
    return F.array_join(F.array_sort(items), " & ")


def split_step(text: Column) -> Column:
    return F.split(text, " & ")


def safe_id(text: Column) -> Column:
    """Slashes become underscores."""
    return F.translate(text, "/\\", "__")


def normalize_host(host: Column) -> Column:
    return F.when(host.endswith("_mail"), "user_mail").otherwise(host)


def short_levels(short: Column) -> tuple[Column, Column]:
    """'A-Acc-Chr1' gives ('A', 'A-Acc')."""
    return F.substring_index(short, "-", 1), F.substring_index(short, "-", 2)


def time_of_day(hour: Column) -> Column:
    parts = F.when(hour.isNull(), "unknown").when(hour.between(5, 9), "morning").when(hour.between(10, 13), "midday")
    return parts.when(hour.between(14, 17), "afternoon").when(hour.between(18, 21), "evening").otherwise("night")


def family(tokens: Column, prefix: str) -> Column:
    """Values of one token family, without the prefix."""
    return F.transform(F.filter(tokens, lambda t: t.startswith(prefix)), lambda t: F.substring(t, F.lit(len(prefix) + 1), F.length(t)))


def scenario_id(names: Column) -> Column:
    """The same for any order and case of the names."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(names, lambda n: F.lower(F.trim(n))))), "+")
