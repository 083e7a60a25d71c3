"""Personal data replaced by pseudonyms of the same format.

Card numbers, phone numbers, addresses, dates and mailbox names are found by pattern and
validated (check digit, octets, calendar). A keyed Feistel network permutes each value inside
its own format: a valid card stays a valid card, a date a date. The permutation depends on
the key and the kind only, so equal values stay equal in every document, and it can be undone
by whoever holds the key.

Only column expressions are used; work is done per match, and matches never leave their row.
Defined results: a null text stays null and an empty one empty, both with no matches; values
that fail validation stay; rows may repeat; an empty table gives no rows. Columns other than
those named are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(?<![\w(+])(?:\+?\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
PHONE_PLAIN = r"(?<![\w.+-])(?:\+\d{1,3}[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]|\.\d)"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?:(?=T\d{2}:\d{2})|(?![\w/-]|\.\d))"
IP = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"
CARD = r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w]|\.\d)"
KINDS = {"email": EMAIL, "phone": f"(?:{PHONE}|{PHONE_PLAIN})", "date": DATE, "ip": IP, "card": CARD}
ANY = "|".join(KINDS.values())

# 1800-01-01 to 2199-12-31 is one whole Gregorian cycle of 146097 = 189 * 773 days
FIRST_DAY, DAY_HIGH, DAY_LOW = "1800-01-01", 189, 773
DATE_FORMS = {"-": "yyyy-MM-dd", ".": "dd.MM.yyyy", "/": "MM/dd/yyyy"}


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def feistel(values: Column, radix: Column, key: str, kind: str, rounds: int = ROUNDS, undo: bool = False) -> Column:
    """Keyed permutation of an array of numbers below their radices; halves take turns."""
    half = F.floor(F.size(values) / 2).cast("int")

    def one(state: Column, r: Column) -> Column:
        left = r % 2 == 0
        other = F.when(left, F.slice(state, half + 1, F.size(state) - half)).otherwise(F.slice(state, F.lit(1), half))
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.array_join(other.cast("array<string>"), ",")), 512)

        def shifted(h: Column) -> Column:
            def step(v: Column, i: Column) -> Column:
                m = F.get(radix, i)
                by = F.conv(F.substring(h, (i * 4) % 128 + 1, F.lit(4)), 16, 10).cast("int")
                moved = F.pmod(v - by, m) if undo else F.pmod(v + by, m)
                return F.when((i < half) == left, moved).otherwise(v)
            return F.transform(state, step)

        return bound(digest, shifted)

    turns = F.array(*[F.lit(r) for r in (reversed(range(rounds)) if undo else range(rounds))])
    return F.aggregate(turns, values.cast("array<int>"), one)


def _digits(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\D", ""), "").cast("array<int>")


def _refill(text: Column, digits: Column) -> Column:
    """The text with its digits, in order, exchanged for others."""
    chars = F.split(text, "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def put(acc: Column, c: Column) -> Column:
        isdigit = c.rlike(r"^\d$")
        return F.struct(F.concat(acc["out"], F.when(isdigit, F.get(digits, acc["n"]).cast("string")).otherwise(c)).alias("out"),
                        (acc["n"] + isdigit.cast("int")).alias("n"))

    return F.aggregate(chars, start, put, lambda acc: acc["out"])


def _luhn_sum(digits: Column) -> Column:
    """Sum over the digits before the check digit, doubling every second from the right."""
    n = F.size(digits)
    weighed = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d)


def _card(m: Column, key: str, undo: bool) -> Column:
    def replaced(d: Column) -> Column:
        body = F.slice(d, F.lit(1), F.size(d) - 1)
        valid = (_luhn_sum(body) + F.element_at(d, -1)) % 10 == 0
        inner = F.slice(d, F.lit(2), F.size(d) - 2)  # the issuer's first digit stays
        moved = feistel(inner, F.transform(inner, lambda _: F.lit(10)), key, "card", undo=undo)

        def checked(b: Column) -> Column:
            return _refill(m, F.concat(b, F.array(((10 - _luhn_sum(b) % 10) % 10).cast("int"))))

        return F.when(valid, bound(F.concat(F.slice(d, F.lit(1), F.lit(1)), moved), checked)).otherwise(m)

    return bound(_digits(m), replaced)


def _phone(m: Column, key: str, undo: bool) -> Column:
    """The last ten digits; a first digit of 2 to 9 in area and exchange stays one of 2 to 9, and 0 or 1 one of those."""
    def replaced(d: Column) -> Column:
        head = F.slice(d, F.lit(1), F.size(d) - 10)
        own = F.slice(d, F.size(d) - 9, F.lit(10))
        leads = lambda i: (i == 0) | (i == 3)
        base = F.transform(own, lambda v, i: F.when(leads(i) & (v >= 2), 2).otherwise(0))
        radix = F.transform(own, lambda v, i: F.when(leads(i), F.when(v >= 2, 8).otherwise(2)).otherwise(10))
        moved = feistel(F.zip_with(own, base, lambda v, b: v - b), radix, key, "phone", undo=undo)
        return _refill(m, F.concat(head, F.zip_with(moved, base, lambda v, b: v + b)))

    return bound(_digits(m), replaced)


def _ip(m: Column, key: str, undo: bool) -> Column:
    octets = F.split(m, r"\.").cast("array<int>")
    moved = feistel(octets, F.array(*[F.lit(256)] * 4), key, "ip", undo=undo)
    return F.when(F.array_max(octets) <= 255, F.array_join(moved.cast("array<string>"), ".")).otherwise(m)


def _date(m: Column, key: str, undo: bool) -> Column:
    first = F.lit(FIRST_DAY).cast("date")

    def in_form(form: str) -> Column:
        n = F.datediff(F.try_to_date(m, form), first)

        def moved(n: Column) -> Column:
            pair = F.array(F.floor(n / DAY_LOW).cast("int"), (n % DAY_LOW).cast("int"))
            new = feistel(pair, F.array(F.lit(DAY_HIGH), F.lit(DAY_LOW)), key, "date", undo=undo)
            return bound(new, lambda p: F.date_format(F.date_add(first, p[0] * DAY_LOW + p[1]), form))

        return F.when((n >= 0) & (n < DAY_HIGH * DAY_LOW), bound(n, moved)).otherwise(m)

    out = m
    for sign, form in DATE_FORMS.items():
        out = F.when(F.contains(m, F.lit(sign)), in_form(form)).otherwise(out)
    return out


def _email(m: Column, key: str, undo: bool) -> Column:
    """Letters and digits of the mailbox name, each within its own class; the domain stays."""
    name = F.substring_index(m, "@", 1)
    rest = F.substring(m, F.length(name) + 1, F.length(m))
    chars = F.split(name, "")

    def replaced(codes: Column) -> Column:
        base = F.transform(codes, lambda c: F.when(c.between(48, 57), 48).when(c.between(65, 90), 65).when(c.between(97, 122), 97).otherwise(c))
        radix = F.transform(codes, lambda c: F.when(c.between(48, 57), 10).when(c.between(65, 90) | c.between(97, 122), 26).otherwise(1))
        moved = feistel(F.zip_with(codes, base, lambda c, b: c - b), radix, key, "email", undo=undo)
        return F.array_join(F.transform(F.zip_with(moved, base, lambda v, b: v + b), lambda c: F.char(c)), "")

    return F.concat(bound(F.transform(chars, lambda c: F.ascii(c)), replaced), rest)


RULES = {"email": _email, "phone": _phone, "date": _date, "ip": _ip, "card": _card}


def pseudonym(match: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of one matched value; of several kinds the first that fits whole counts."""
    out = match
    for kind in reversed(list(KINDS)):
        out = F.when(match.rlike(f"^(?:{KINDS[kind]})$"), RULES[kind](match, key, undo)).otherwise(out)
    return out


def spare(docs: DataFrame, name: str) -> str:
    """The name, longer where ``docs`` has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def pseudonymise(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """The same rows with personal values exchanged in ``text``, and ``n_replaced`` behind."""
    text = F.col("text").cast("string")
    found, new = spare(docs, "_found"), spare(docs, "_new")
    marked = docs.drop("n_replaced").withColumn(found, F.regexp_extract_all(text, F.lit(f"({ANY})"), 1))
    changed = marked.withColumn(
        new, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key, undo))).otherwise(F.col(found)))
    joined = F.array_join(
        F.zip_with(F.split(text, ANY, -1), F.concat(F.col(new), F.array(F.lit(""))), lambda part, m: F.concat(part, m)), "")
    count = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    return (
        changed.withColumn("n_replaced", F.when(F.size(found) > 0, count).otherwise(0).cast("bigint"))
        .withColumn("text", F.when(F.size(found) > 0, joined).otherwise(text)).drop(found, new)
    )
