"""PII pseudonyms by keyed Feistel permutations within a value's own format.

Found and validated: e-mail addresses, payment card numbers (Luhn), IBANs
(mod 97), US social security numbers, calendar dates (ISO, and day/month/year
or, where there is no such day, month/day/year with four-digit years), phone
numbers and IPv4 addresses. Each kind's values
are numbered 0..a*b-1; an alternating Feistel network over the two digits of
that mixed radix permutes the numbers under the key, so the result is again a
value of the kind, different values stay different, and equal values get the
same pseudonym in every document. Check digits are computed anew; separators,
letter case and e-mail domains stay; the names of addresses that differ in case
only get pseudonyms that differ in case only. A value that is not valid stays as
it is. The key enters the plan as a column of a one-row table, so it doesn't show
in plans or logs.

Column expressions over one row, nothing is exchanged. Defined results: a null
text stays null with zero counts; empty texts and texts without findings are
unchanged; repeated rows give repeated results; an empty table gives an empty
result; extra columns are ignored by ``pseudonymise``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import checked_columns
from alertloom.llm.secret_scan import let

ROUNDS = 8
KINDS = ("email", "iban", "card", "ssn", "date", "phone", "ipv4")
#: Fixed formats, by kind; the first that fits at a place wins. Each is matched without recursion and from one
#: place of a run only, so no text is too long. A name before the at sign has 64 characters at most, as the standard
#: has it; an address is read up to its first label that may be a top-level domain, for what follows stays anyway.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?=[A-Za-z0-9-])(?:[A-Za-z0-9-]|\.(?![A-Za-z]{2}|\.))++\.[A-Za-z]{2,}+",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "date": r"(?<![0-9][-/.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9A-Za-z-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])",
    "ipv4": r"(?<![0-9]\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
}
FIND = r"(?<![0-9A-Za-z])(?:" + "|".join(PATTERNS.values()) + ")"
#: Dates move within this span: one 400-year cycle of 146,097 = 773 * 189 days.
FIRST_DAY, DAYS = "1800-01-01", (773, 189)
#: Of these, 88,497 = 9833 * 9 lie after a month's 12th: month/day/year dates move among them.
LATE_DAYS = (9833, 9)


def _word(key: str | Column, kind: str, r: Column, value: Column, modulus: Column) -> Column:
    """A keyed pseudo-random number below ``modulus``."""
    digest = F.sha2(F.concat_ws("|", _key(key), F.lit(kind), r.cast("string"), value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), modulus)


def _key(key: str | Column) -> Column:
    return key if isinstance(key, Column) else F.lit(key)


def _div(x: Column, y: Column) -> Column:
    """Whole quotient of non-negative longs."""
    return F.floor((x - F.pmod(x, y)).cast("decimal(20,0)") / y.cast("decimal(20,0)")).cast("bigint")


def permute(x: Column, a: Column, b: Column, key: str | Column, kind: str) -> Column:
    """A keyed permutation of 0..a*b-1, where a and b are up to 10**10."""

    def step(acc: Column, r: Column) -> Column:
        left = F.pmod(acc["l"] + _word(key, kind, r, acc["r"], a), a)
        return let(left, lambda l: F.struct(l.alias("l"), F.pmod(acc["r"] + _word(key, kind + "'", r, l, b), b).alias("r")))

    start = F.struct(_div(x, b).alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: acc["l"] * b + acc["r"])


def permute_digits(digits: Column, key: str | Column, kind: str) -> Column:
    """A decimal string permuted among those of its length (1 to 19)."""

    def mixed(d: Column) -> Column:
        n = F.length(d)
        low = F.floor(n / 2).cast("int") + 1
        ten = lambda k: F.pow(F.lit(10.0), k).cast("bigint")
        right = F.least(low, n)
        halves = F.struct(F.coalesce(F.nullif(F.substring(d, F.lit(1), n - right), F.lit("")), F.lit("0")).cast("bigint").alias("l"), F.substring(d, n - right + 1, right).cast("bigint").alias("r"))
        a, b = ten(n - right), ten(right)

        def step(acc: Column, r: Column) -> Column:
            tag = F.concat_ws(".", r.cast("string"), n.cast("string"))
            left = F.pmod(acc["l"] + _word(key, kind, tag, acc["r"], a), a)
            return let(left, lambda l: F.struct(l.alias("l"), F.pmod(acc["r"] + _word(key, kind + "'", tag, l, b), b).alias("r")))

        end = lambda acc: F.concat(F.when(n > right, F.lpad(acc["l"].cast("string"), n - right, "0")).otherwise(""), F.lpad(acc["r"].cast("string"), right, "0"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), halves, step, end)

    return let(digits, mixed)


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order."""
    zero = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct((acc["at"] + F.when(digit, 1).otherwise(0)).alias("at"), F.concat(acc["out"], F.when(digit, F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(shape, ""), zero, step, lambda acc: acc["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum modulo 10, the last digit undoubled."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10


def _mod97(text: Column) -> Column:
    """An IBAN's remainder: its first four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.try_to_number(c, F.lit("9")).cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: let(value(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97))


def _email(x: Column, key: str | Column) -> Column:
    """Letters and digits before the at sign, permuted pairwise within their classes."""
    local = F.substring_index(x, "@", 1)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def build(name: Column) -> Column:
        chars = F.split(name, "")
        shift = lambda c, alphabet, tag: F.substring(F.lit(alphabet), (F.pmod(F.call_function("instr", F.lit(alphabet), c) - 1 + tag, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))

        def one_round(acc: Column, r: Column) -> Column:
            # Characters at even places move by a word of those at odd places, then the other way round.
            def half(current: Column, parity: int) -> Column:
                other = F.lower(F.array_join(F.filter(current, lambda _, i: i % 2 != parity), ""))
                digest = F.sha2(F.concat_ws("|", _key(key), F.lit("email"), r.cast("string"), F.lit(str(parity)), F.size(current).cast("string"), other), 256)
                word = lambda i: F.conv(F.substring(F.sha2(F.concat_ws(".", digest, i.cast("string")), 256), 1, 7), 16, 10).cast("int")
                return F.transform(
                    current,
                    lambda c, i: F.when(i % 2 != parity, c)
                    .when(c.rlike("[a-z]"), shift(c, lower, word(i)))
                    .when(c.rlike("[A-Z]"), F.upper(shift(F.lower(c), lower, word(i))))
                    .when(c.rlike("[0-9]"), shift(c, digits, word(i)))
                    .otherwise(c),
                )

            return let(half(acc, 0), lambda first: half(first, 1))

        return F.array_join(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), chars, one_round), "")

    return F.concat(let(local, build), F.substring(x, F.length(local) + 1, F.length(x)))


def _card(x: Column, key: str | Column) -> Column:
    def build(digits: Column) -> Column:
        body = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        return let(body, lambda b: _refill(x, F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))

    return let(_only_digits(x), build)


def _iban(x: Column, key: str | Column) -> Column:
    def build(bare: Column) -> Column:
        body = F.substring(bare, F.lit(5), F.length(bare))
        digits = _only_digits(body)
        wide = F.concat(permute_digits(F.substring(digits, 1, 15), key, "iban"), F.when(F.length(digits) > 15, permute_digits(F.substring(digits, F.lit(16), F.length(digits)), key, "iban+")).otherwise(""))
        fresh = F.when(F.length(digits) > 0, _refill(body, wide)).otherwise(body)
        checked = lambda b: F.concat(F.substring(bare, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(bare, 1, 2), F.lit("00"), b))).cast("string"), 2, "0"), b)
        return let(fresh, lambda b: let(checked(b), lambda full: _respace(x, full)))

    return let(F.replace(x, F.lit(" "), F.lit("")), build)


def _respace(shape: Column, bare: Column) -> Column:
    """``bare`` with the blanks of ``shape``."""
    zero = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        blank = c == " "
        return F.struct((acc["at"] + F.when(blank, 0).otherwise(1)).alias("at"), F.concat(acc["out"], F.when(blank, c).otherwise(F.substring(bare, acc["at"], F.lit(1)))).alias("out"))

    return F.aggregate(F.split(shape, ""), zero, step, lambda acc: acc["out"])


def _ssn(x: Column, key: str | Column) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area = F.substring(x, 1, 3).cast("bigint")
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    number = (rank * 99 + F.substring(x, 5, 2).cast("bigint") - 1) * 9999 + F.substring(x, 8, 4).cast("bigint") - 1

    def show(n: Column) -> Column:
        top = _div(n, F.lit(9999 * 99))
        fresh = top + 1 + F.when(top >= 665, 1).otherwise(0)
        pad = lambda v, k: F.lpad(v.cast("string"), k, "0")
        return F.concat_ws("-", pad(fresh, 3), pad(_div(n, F.lit(9999)) % 99 + 1, 2), pad(n % 9999 + 1, 4))

    return let(permute(number, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"), key, "ssn"), show)


def _day(x: Column) -> Column:
    """ISO or day/month/year."""
    iso = F.try_to_date(x, "yyyy-MM-dd")
    return F.when(x.rlike("^[0-9]{4}-"), iso).otherwise(F.try_to_date(F.translate(x, ".", "/"), "dd/MM/yyyy"))


def _american_day(x: Column) -> Column:
    """Month/day/year."""
    return F.try_to_date(F.translate(x, ".", "/"), "MM/dd/yyyy")


def _date(x: Column, key: str | Column) -> Column:
    number = F.date_diff(_day(x), F.lit(FIRST_DAY).cast("date")).cast("bigint")
    moved = permute(number, F.lit(DAYS[0]).cast("bigint"), F.lit(DAYS[1]).cast("bigint"), key, "date")
    fresh = F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int"))
    show = lambda d: F.when(x.rlike("^[0-9]{4}-"), F.date_format(d, "yyyy-MM-dd")).when(x.contains("."), F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    return F.when(_day(x).isNotNull(), let(fresh, show)).otherwise(_american_date(x, key))


def _american_date(x: Column, key: str | Column) -> Column:
    """Permuted among the days after a month's 12th, which can't be read day first."""
    first = F.lit(FIRST_DAY).cast("date")
    month_start = lambda m: F.add_months(first, m.cast("int"))
    #: Late days before a month.
    earlier = lambda m: F.date_diff(month_start(m), first) - 12 * m
    day = _american_day(x)
    months = (F.year(day) - int(FIRST_DAY[:4])) * 12 + F.month(day) - 1
    number = let(months, earlier).cast("bigint") + F.dayofmonth(day) - 13
    moved = permute(number, F.lit(LATE_DAYS[0]).cast("bigint"), F.lit(LATE_DAYS[1]).cast("bigint"), key, "date'")

    def show(n: Column) -> Column:
        about = F.floor(n * F.lit(4800 / (LATE_DAYS[0] * LATE_DAYS[1]))).cast("int")
        month = F.array_max(F.filter(F.sequence(about - 2, about + 2), lambda m: earlier(m) <= n))
        fresh = let(month, lambda m: F.date_add(month_start(m), (n - earlier(m) + 12).cast("int")))
        return let(fresh, lambda d: F.when(x.contains("."), F.date_format(d, "MM.dd.yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")))

    return let(moved, show)


def _phone(x: Column, key: str | Column) -> Column:
    """The last ten digits at most, so that a country's prefix stays where there are more."""

    def build(digits: Column) -> Column:
        n = F.least(F.length(digits) - F.when(x.startswith("+"), 1).otherwise(0), F.lit(10))
        fresh = F.concat(F.substring(digits, F.lit(1), F.length(digits) - n), permute_digits(F.substring(digits, F.length(digits) - n + 1, n), key, "phone"))
        return let(fresh, lambda d: _refill(x, d))

    return let(_only_digits(x), build)


def _ipv4(x: Column, key: str | Column) -> Column:
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("bigint"))
    number = F.aggregate(octets, F.expr("0L"), lambda a, o: a * 256 + o)
    side = F.lit(65_536).cast("bigint")
    show = lambda n: F.concat_ws(".", *[(F.shiftright(n, s).bitwiseAND(255)).cast("string") for s in (24, 16, 8, 0)])
    return let(permute(number, side, side, key, "ipv4"), show)


def kind_of(x: Column) -> Column:
    """Kind of a validated value, or null."""
    fits = lambda kind: x.rlike("^(?:" + PATTERNS[kind] + ")$")
    valid: dict[str, Callable[[], Column]] = {
        "email": lambda: F.lit(True),
        "iban": lambda: let(F.replace(x, F.lit(" "), F.lit("")), lambda b: F.length(b).between(15, 34) & (_mod97(b) == 1)),
        "card": lambda: luhn_sum(_only_digits(x)) == 0,
        "ssn": lambda: ~x.rlike("^(?:000|666|9)|-00-|-0000$"),
        "date": lambda: F.coalesce(F.coalesce(_day(x), _american_day(x)).between(F.lit(FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date")), F.lit(False)),
        "phone": lambda: F.length(_only_digits(x)).between(7, 15),
        "ipv4": lambda: F.forall(F.split(x, r"\."), lambda o: o.cast("int") <= 255),
    }
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(fits(kind) & valid[kind](), kind).otherwise(out)
    return out


def pseudonym(x: Column, kind: Column, key: str | Column) -> Column:
    """The pseudonym of a validated value of a kind."""
    make = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "date": _date, "phone": _phone, "ipv4": _ipv4}
    out = x
    for name in KINDS:
        out = F.when(kind == name, make[name](x, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str | Column) -> DataFrame:
    """doc_id, text with pseudonyms, n_found and the count of each kind."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<old:string,kind:string>>")
    found = F.transform(F.regexp_extract_all(text, F.lit(FIND), F.lit(0)), lambda x: F.struct(x.alias("old"), kind_of(x).alias("kind")))
    secret = docs.sparkSession.sql("SELECT * FROM VALUES (:key) AS t(key)", args={"key": key}).scalar()
    rows = checked_columns(docs, "doc_id", "text").withColumn("key", secret).withColumn("found", F.when(text.rlike("[0-9]|@"), found).otherwise(none))
    fresh = F.transform("found", lambda v: F.when(v["kind"].isNull(), v["old"]).otherwise(pseudonym(v["old"], v["kind"], F.col("key"))))
    rows = rows.withColumn("fresh", fresh)
    gaps = F.split(text, FIND, -1)
    woven = F.array_join(F.zip_with(gaps, "fresh", lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    count = lambda kind: F.size(F.filter("found", lambda v: v["kind"] == kind)).cast("bigint")
    any_kind = F.size(F.filter("found", lambda v: v["kind"].isNotNull())).cast("bigint")
    return rows.select("doc_id", F.when(any_kind > 0, woven).otherwise(F.col("text")).alias("text"), any_kind.alias("n_found"), *[count(k).alias(f"n_{k}") for k in KINDS])
