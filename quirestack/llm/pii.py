"""Format-preserving pseudonyms by a Feistel network, in DataFrame expressions only.

Numbers that validate (cards by their check digit, account numbers by their remainder, IPv4 octets,
phones), calendar dates, names in mail addresses, access keys and long hexadecimal secrets are found by
patterns; each is permuted under a key inside its own format.  A permutation maps equal values to equal
pseudonyms in every document and different values to different ones, so records stay linked; a card's
pseudonym has a valid check digit, a date's is a date of as many digits, a name's has letters and digits
where the name had them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Rounds of the network.
ROUNDS = 6
#: Key of the registered query; production jobs pass their own.
QUERY_KEY = "public test key"

# ---- the permutation -------------------------------------------------------------------------


def _secrets(tweak: str, key: str) -> Column:
    """What the hashes of each round start from."""
    return F.array(*[F.lit(hashlib.sha256(f"{key}/{tweak}/{i}".encode()).hexdigest()) for i in range(ROUNDS)])


def _hashed(secret: Column, half: Column) -> Column:
    """48 bits of SHA-256 over a round's secret and a half."""
    digest = F.sha2(F.concat_ws("/", secret, half).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), make), 1)


def permute(value: Column, left: int | Column, right: int | Column, tweak: str, key: str, kind: Column | None = None) -> Column:
    """A keyed permutation of the integers from 0 below left * right, as long; kind: a column that tweaks it further.

    The halves a = value div right and b = value mod right are moved in turn by a hash of the other,
    each within its own modulus, so every round can be undone.
    """
    left, right = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (left, right))
    v = value.cast("long")

    def state(half: Column, m: Column, other: Column, n: Column) -> Column:
        return F.struct(half.alias("half"), m.alias("m"), other.alias("other"), n.alias("n"))

    def moved(x: Column, secret: Column) -> Column:
        """The halves change places, so that the same move does for every round."""
        seen = x["other"].cast("string") if kind is None else F.concat_ws("/", kind, x["other"].cast("string"))
        return state(x["other"], x["n"], F.pmod(x["half"] + F.pmod(_hashed(secret, seen), x["m"]), x["m"]), x["m"])

    start = state(F.call_function("div", v, right), left, F.pmod(v, right), right)
    return F.aggregate(_secrets(tweak, key), start, moved, lambda x: x["half"] * right + x["other"])


def permute_characters(plain: Column, tweak: Column, name: str, key: str, alphabet: str | None = None) -> Column:
    """A keyed permutation of the strings of lower-case letters and digits that have letters and digits at the same places.

    With an alphabet, of all strings of the length over it.  Both halves of the string are moved in turn,
    each character within its own class by a stream of hash bytes of the other half.
    """
    if alphabet is None:
        place = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 97)
        size = lambda c: F.when(c.between("0", "9"), 10).otherwise(26)
        shown = lambda v, m: F.when(m == 10, F.chr(v + 48)).otherwise(F.chr(v + 97))
    else:
        place, size = lambda c: F.instr(F.lit(alphabet), c) - 1, lambda c: F.lit(len(alphabet))
        shown = lambda v, m: F.substr(F.lit(alphabet), v + 1, F.lit(1))

    def stream(secret: Column, other: Column, n: Column) -> Column:
        about = F.concat_ws("/", secret, tweak, F.array_join(F.transform(other, lambda v: v.cast("string")), ","))
        hexes = F.array_join(F.transform(F.sequence(F.lit(0), F.call_function("div", n, F.lit(32)).cast("int")), lambda j: F.sha2(F.concat_ws("/", about, j.cast("string")).cast("binary"), 256)), "")
        return _bound(hexes, lambda h: F.transform(_from_to(F.lit(1), n), lambda p: F.conv(h.substr(2 * p - 1, F.lit(2)), 16, 10).cast("int")))

    def state(half: Column, m: Column, other: Column, n: Column) -> Column:
        return F.struct(half.alias("half"), m.alias("m"), other.alias("other"), n.alias("n"))

    def moved(x: Column, secret: Column) -> Column:
        add = lambda s: F.transform(x["half"], lambda v, p: F.pmod(v + s[p], x["m"][p]))
        return state(x["other"], x["n"], _bound(stream(secret, x["other"], F.size(x["half"])), add), x["m"])

    def whole(x: Column) -> Column:
        return F.array_join(F.zip_with(F.concat(x["half"], x["other"]), F.concat(x["m"], x["n"]), shown), "")

    def halves(chars: Column) -> Column:
        k = F.call_function("div", F.size(chars), F.lit(2)).cast("int")
        values, sizes = F.transform(chars, place), F.transform(chars, size)
        first = lambda v: F.slice(v, 1, k)
        last = lambda v: F.slice(v, k + 1, F.size(chars) - k)
        return state(first(values), first(sizes), last(values), last(sizes))

    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    return F.aggregate(_secrets(name, key), _bound(chars, halves), moved, whole)


# ---- formats ---------------------------------------------------------------------------------
# The shapes that are looked for, in order of precedence at one place; cards follow below.  Possessive
# repetition and the tests before each shape keep the search linear in the text.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_PART = r"(?<![0-9A-Za-z])"
_COUNTRY = "(?:A[DELTZ]|B[AEGHRY]|C[HRYZ]|D[EKO]|E[EGS]|F[IOR]|G[BEILRT]|H[RU]|I[ELQST]|JO|K[WZ]|L[BCITUVY]|M[CDEKRTU]|N[LO]|P[KLST]|QA|R[OS]|S[ACEIKMTV]|T[LNR]|UA|V[AG]|XK)"
_WHOLE = r"(?![0-9A-Za-z])"
#: Shapes that begin where no letter or digit stands before.
_WORDS = {
    "secret": r"[0-9A-Fa-f]{32,}+" + _WHOLE,
    "iban": _COUNTRY + r"[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _WHOLE,
    "access_key": r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsru]_[0-9A-Za-z]{36,}+|xox[abprs]-[0-9A-Za-z-]{10,}+|sk-[0-9A-Za-z_-]{20,}+)" + _WHOLE,
    "ip": r"(?<!\.)" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![0-9A-Za-z]|\.[0-9])",
    "iso_date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}" + _WHOLE,
    "day_date": r"[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}" + _WHOLE,
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _WHOLE,
    "local_phone": r"[0-9]{3}-[0-9]{3}-[0-9]{4}" + _WHOLE,
}
#: Other shapes: before the words, and after them.
_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_PHONES = {"phone": r"\+[0-9](?:[ ().-]{0,2}[0-9]){7,14}(?![0-9])", "area_phone": r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}" + _WHOLE}
SHAPES = {"mail": _MAIL} | {k: _PART + v for k, v in _WORDS.items()} | _PHONES
ANY = f"(?:{_MAIL})|{_PART}(?:" + "|".join(f"(?:{p})" for p in _WORDS.values()) + ")|" + "|".join(f"(?:{p})" for p in _PHONES.values())
#: Texts without a match of this hold none of the shapes.
MAY_HOLD = "[0-9@]|AKIA|ASIA|gh[opsru]_|xox[abprs]-|sk-"
#: Groups of digits, parted by single spaces or dashes, in which cards are looked for outside the other shapes.
CHAIN = _PART + r"(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ -][0-9]++(?![A-Za-z]))*+"
#: Digits of a card, and the sizes of groups in which cards are written; a single group may have any of these sizes.
CARD_LEAST, CARD_MOST, CARD_GROUPS = 13, 19, ("4-4-4-4", "4-6-5", "4-6-4")
#: Years whose dates keep to themselves, so that a usual date gets a usual one; all other years from 1 to 9999 form a second range.
NEAR_FROM, NEAR_YEARS = 1900, 200
#: Times a date may be moved on until it exists; 3 % of places are days that a month lacks, so none is left after so many.
WALK = 16


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _fill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    return F.aggregate(
        F.split(shape, ""),
        start,
        lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["s"], digits.substr(a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(
            F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))
        ),
        lambda a: a["s"],
    )


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, its last digit counting once."""
    places = F.sequence(F.lit(1), F.length(digits))
    values = F.transform(places, lambda i: digits.substr(i, F.lit(1)).cast("int") * (F.pmod(F.length(digits) - i, F.lit(2)) + 1))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def _permuted_digits(digits: Column, tweak: str, key: str) -> Column:
    """A string of at most 18 digits permuted among those of its length."""

    def made(n: Column) -> Column:
        power = lambda k: F.element_at(F.lit([10**i for i in range(10)]), (k + 1).cast("int")).cast("long")
        half = F.call_function("div", n, F.lit(2))
        return F.lpad(permute(digits, power(half), power(n - half), tweak, key, n.cast("string")).cast("string"), n, "0")

    return _bound(F.length(digits), made)


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = digits.substr(F.lit(1), F.length(digits) - 1)
    fresh = _permuted_digits(body, "card", key)
    whole = F.concat(fresh, F.pmod(-_luhn(F.concat(fresh, F.lit("0"))), F.lit(10)).cast("string"))
    return F.when(F.pmod(_luhn(digits), F.lit(10)) == 0, _fill(m, whole))


def _piece(raw: Column, kind: Column, value: Column) -> Column:
    return F.struct(raw.alias("raw"), kind.cast("string").alias("kind"), value.cast("string").alias("value"))


def _plain(raw: Column) -> Column:
    return _piece(raw, F.lit(None), F.lit(None))


def _from_to(first: Column, last: Column) -> Column:
    """The integers from first to last, none if last is smaller."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _card_spans(groups: Column) -> Column:
    """array<struct<i,j>>: the runs of whole groups, from i to j, that are cards, in order and apart from each other.

    A card has a valid check digit.  From left to right, a run of groups as cards are written, with an
    issuer's first digit, is taken first; any other run is taken if none such begins inside it, the
    longest first.
    """

    def run(i: Column, j: Column) -> Column:
        part = F.slice(groups, i, j - i + 1)
        sizes = F.array_join(F.transform(part, lambda x: F.length(x).cast("string")), "-")
        usual = ((i == j) | sizes.isin(*CARD_GROUPS)) & F.element_at(part, 1).rlike("^[2-6]")
        return F.struct(j.alias("j"), F.array_join(part, "").alias("d"), usual.alias("usual"))

    def valid(x: Column) -> Column:
        return F.length(x["d"]).between(CARD_LEAST, CARD_MOST) & (F.pmod(_luhn(x["d"]), F.lit(10)) == 0)

    def starting(i: Column) -> Column:
        ends = _from_to(i, F.least(i + CARD_MOST - 1, F.size(groups)))
        return F.transform(F.filter(F.transform(ends, lambda j: run(i, j)), valid), lambda x: F.struct(x["j"], x["usual"]))

    def last(runs: Column, usual: Column, i: Column) -> Column:
        free = F.filter(runs[i - 1], lambda x: ~x["usual"] & ~F.exists(F.slice(usual, i + 1, x["j"] - i), lambda u: u > 0))
        return F.when(usual[i - 1] > 0, usual[i - 1]).otherwise(F.coalesce(F.array_max(F.transform(free, lambda x: x["j"])), F.lit(0)))

    def chosen(runs: Column, usual: Column) -> Column:
        ends = F.transform(_from_to(F.lit(1), F.size(groups)), lambda i: F.struct(i.alias("i"), last(runs, usual, i).alias("j")))
        none = F.struct(F.array().cast("array<struct<i:int,j:int>>").alias("s"), F.lit(0).alias("j"))
        taken = lambda a, x: F.struct(F.concat(a["s"], F.array(F.struct(x["i"], x["j"]))).alias("s"), x["j"].alias("j"))
        return F.aggregate(F.filter(ends, lambda x: x["j"] > 0), none, lambda a, x: F.when(x["i"] > a["j"], taken(a, x)).otherwise(a), lambda a: a["s"])

    def first_usual(runs: Column) -> Column:
        return F.transform(runs, lambda r: F.coalesce(F.array_max(F.transform(F.filter(r, lambda x: x["usual"]), lambda x: x["j"])), F.lit(0)))

    every = F.transform(_from_to(F.lit(1), F.size(groups)), starting)
    return _bound(every, lambda runs: _bound(first_usual(runs), lambda usual: chosen(runs, usual)))


def _chain_pieces(chain: Column, key: str) -> Column:
    """array<struct<raw,kind,value>> of a chain of groups: its cards and what stands between them."""

    def made(parts: Column, spans: Column) -> Column:
        text = lambda i, j: F.array_join(F.slice(parts, i, F.greatest(j - i + 1, F.lit(0))), "")

        def card(s: Column, n: Column) -> Column:
            before = F.when(n > 0, spans[n - 1]["j"]).otherwise(0)
            whole = text(s["i"], s["j"])
            own = F.regexp_extract(whole, "^(.*[0-9])([ -]?)$", 1)
            return F.array(
                _plain(text(before + 1, s["i"] - 1)),
                _bound(own, lambda m: _piece(m, F.lit("card"), _card(m, key))),
                _plain(F.regexp_extract(whole, "^(.*[0-9])([ -]?)$", 2)),
            )

        end = F.coalesce(F.array_max(F.transform(spans, lambda s: s["j"])), F.lit(0))
        return F.concat(F.flatten(F.transform(spans, card)), F.array(_plain(text(end + 1, F.size(parts)))))

    parts = F.split(chain, "(?<=[ -])")  # each group with the mark behind it
    return _bound(parts, lambda p: _bound(F.transform(p, _digits), lambda g: _bound(_card_spans(g), lambda s: made(p, s))))


def _card_pieces(gap: Column, key: str) -> Column:
    """array<struct<raw,kind,value>> of a text: its cards and what stands between them."""
    chains = F.regexp_extract_all(gap, F.lit(CHAIN), F.lit(0))
    both = F.zip_with(F.split(gap, CHAIN, -1), chains, lambda g, c: F.when(c.isNull(), F.array(_plain(g))).otherwise(F.concat(F.array(_plain(g)), _chain_pieces(c, key))))
    return F.when(gap.rlike(CHAIN), F.flatten(both)).otherwise(F.array(_plain(gap)))


def _phone(m: Column, key: str) -> Column:
    digits = _digits(m)
    rest = digits.substr(F.lit(2), F.length(digits))  # the first digit, of the country code, stays
    return _fill(m, F.concat(digits.substr(1, 1), _permuted_digits(rest, "phone", key)))


def _local_phone(m: Column, key: str) -> Column:
    return _fill(m, _permuted_digits(_digits(m), "phone", key))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    fresh = F.array(permute(number, 1 << 16, 1 << 16, "ip", key))
    name = F.transform(fresh, lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, k), F.lit(256)).cast("string") for k in (24, 16, 8, 0)]))
    return F.element_at(name, 1)


def _month_days(y: Column, m: Column) -> Column:
    leap = ((F.pmod(y, F.lit(4)) == 0) & (F.pmod(y, F.lit(100)) != 0)) | (F.pmod(y, F.lit(400)) == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _exists(x: Column) -> Column:
    return x["y"].between(1, 9999) & x["m"].between(1, 12) & (x["d"] >= 1) & (x["d"] <= _month_days(x["y"], x["m"]))


def _moved_date(date: Column, key: str) -> Column:
    """The pseudonym struct<y,m,d> of an existing date: of the same range of years and as many digits of month and day.

    Its place among years, months and days of its class is permuted, and again while that day doesn't
    exist, which is a permutation of the dates that do.
    """

    def walked(x: Column) -> Column:
        near = x["y"].between(NEAR_FROM, NEAR_FROM + NEAR_YEARS - 1)
        long_month, long_day = x["m"] >= 10, x["d"] >= 10
        kind = F.concat(*[c.cast("string") for c in (near, long_month, long_day)])
        m0, d0 = F.when(long_month, 10).otherwise(1), F.when(long_day, 10).otherwise(1)
        days = F.when(long_day, 22).otherwise(9)
        of_year = (days * F.when(long_month, 3).otherwise(9)).cast("long")
        years = F.when(near, NEAR_YEARS).otherwise(9999 - NEAR_YEARS).cast("long")
        year = F.when(near, x["y"] - NEAR_FROM).when(x["y"] < NEAR_FROM, x["y"] - 1).otherwise(x["y"] - NEAR_YEARS - 1)
        place = year * of_year + (x["m"] - m0) * days + x["d"] - d0

        def at(v: Column) -> Column:
            y, rest = F.call_function("div", v, of_year).cast("int"), F.pmod(v, of_year).cast("int")
            y = F.when(near, y + NEAR_FROM).when(y + 1 < NEAR_FROM, y + 1).otherwise(y + NEAR_YEARS + 1)
            return F.struct(y.alias("y"), (F.call_function("div", rest, days).cast("int") + m0).alias("m"), (F.pmod(rest, days) + d0).alias("d"), v.alias("v"))

        def step(v: Column) -> Column:
            return _bound(permute(v, years, of_year, "date", key, kind), at)

        none = F.lit(None).cast("struct<y:int,m:int,d:int,v:bigint>")
        start = F.struct(none.alias("found"), place.cast("long").alias("v"))
        walk = F.aggregate(
            F.sequence(F.lit(1), F.lit(WALK)), start,
            lambda a, _: F.when(a["found"].isNotNull(), a).otherwise(_bound(step(a["v"]), lambda n: F.struct(F.when(_exists(n), n).alias("found"), n["v"].alias("v")))),
        )
        return walk["found"]

    return _bound(date, lambda x: F.when(_exists(x), walked(x)))


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for c, n in ((y, "y"), (m, "m"), (d, "d"))])


def _padded(n: Column, like: Column) -> Column:
    """n with as many digits as like has."""
    return F.lpad(n.cast("string"), F.length(like), "0")


def _iso_date(m: Column, key: str) -> Column:
    parts = F.split(m, "-")
    return _bound(_moved_date(_date(parts[0], parts[1], parts[2]), key), lambda x: F.when(x.isNotNull(), F.concat_ws("-", *[F.lpad(x[c].cast("string"), n, "0") for c, n in (("y", 4), ("m", 2), ("d", 2))])))


def _day_date(m: Column, key: str) -> Column:
    """Day before month if such a date exists, else month before day; each part keeps its number of digits."""
    mark = F.when(F.contains(m, F.lit("/")), "/").otherwise(".")
    parts = F.split(m, "[./]")
    day_first, month_first = _date(parts[2], parts[1], parts[0]), _date(parts[2], parts[0], parts[1])

    def ordered(by_day: Column) -> Column:
        def shown(x: Column) -> Column:
            one, two = F.when(by_day, x["d"]).otherwise(x["m"]), F.when(by_day, x["m"]).otherwise(x["d"])
            return F.when(x.isNotNull(), F.concat(_padded(one, parts[0]), mark, _padded(two, parts[1]), mark, F.lpad(x["y"].cast("string"), 4, "0")))

        return _bound(_moved_date(F.when(by_day, day_first).otherwise(month_first), key), shown)

    return _bound(_exists(day_first), ordered)


def _ssn(m: Column, key: str) -> Column:
    parts = F.split(m, "-")
    area, group, serial = (parts[i].cast("long") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = (area - F.when(area > 666, 2).otherwise(1)) * (99 * 9999) + (group - 1) * 9999 + serial - 1
    fresh = F.array(permute(index, 898, 99 * 9999, "ssn", key))

    def shown(v: Column) -> Column:
        a = F.call_function("div", v, F.lit(99 * 9999).cast("long")) + 1
        rest = F.pmod(v, F.lit(99 * 9999).cast("long"))
        return F.concat_ws(
            "-",
            F.lpad(F.when(a >= 666, a + 1).otherwise(a).cast("string"), 3, "0"),
            F.lpad((F.call_function("div", rest, F.lit(9999).cast("long")) + 1).cast("string"), 2, "0"),
            F.lpad((F.pmod(rest, F.lit(9999).cast("long")) + 1).cast("string"), 4, "0"),
        )

    return F.when(valid, F.element_at(F.transform(fresh, shown), 1))


def _refilled(shape: Column, fresh: Column) -> Column:
    """shape with its letters and digits replaced in order by those of fresh, letters in the case they had."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def next_one(a: Column, c: Column) -> Column:
        put = fresh.substr(a["i"], F.lit(1))
        put = F.when(c.between("A", "Z"), F.upper(put)).otherwise(put)
        return F.when(c.rlike("^[0-9A-Za-z]$"), F.struct(F.concat(a["s"], put).alias("s"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i")))

    return F.aggregate(F.split(shape, ""), start, next_one, lambda a: a["s"])


def _renamed(m: Column, tweak: Column, name: str, key: str) -> Column:
    """m with its letters and digits permuted, case, marks and classes kept; spellings that differ in case stay linked."""
    plain = F.regexp_replace(F.lower(m), "[^a-z0-9]", "")
    return _bound(permute_characters(plain, tweak, name, key), lambda fresh: _refilled(m, fresh))


def _secret(m: Column, key: str) -> Column:
    """A secret becomes another string of as many hexadecimal digits.

    Upper and lower case give the same one; it is in upper case where all letters of the secret are.
    """
    fresh = permute_characters(F.lower(m), F.lit(""), "secret", key, "0123456789abcdef")
    return _bound(fresh, lambda x: F.when(m.rlike("[a-f]") | ~m.rlike("[A-F]"), x).otherwise(F.upper(x)))


def _access_key(m: Column, key: str) -> Column:
    """The prefix that tells the issuer stays."""
    head = F.regexp_extract(m, "^(AKIA|ASIA|gh[a-z]_|xox[a-z]-|sk-)", 1)
    return F.concat(head, _renamed(m.substr(F.length(head) + 1, F.length(m)), F.lit(""), "access key", key))


def _mail(m: Column, key: str) -> Column:
    """The name before the @ is permuted under a tweak of the host, which stays."""
    host = F.substring_index(m, "@", -1)
    return F.concat(_renamed(F.substring_index(m, "@", 1), F.lower(host), "mail", key), F.lit("@"), host)


def _remainder(account: Column) -> Column:
    """The remainder modulo 97 of an account number whose first four characters are read last, letters as 10 to 35."""
    turned = F.concat(account.substr(F.lit(5), F.length(account)), account.substr(F.lit(1), F.lit(4)))
    digit = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.pmod(F.when(c.between("0", "9"), a * 10).otherwise(a * 100) + digit(c), F.lit(97)))


def _iban(m: Column, key: str) -> Column:
    """An account number that validates keeps its country and grouping; its pseudonym validates, too."""
    plain = F.regexp_replace(m, " ", "")
    land = plain.substr(F.lit(1), F.lit(2))

    def whole(body: Column) -> Column:
        return F.concat(land, F.lpad((98 - _remainder(F.concat(land, F.lit("00"), body))).cast("string"), 2, "0"), body)

    fresh = F.upper(permute_characters(F.lower(plain.substr(F.lit(5), F.length(plain))), land, "iban", key))
    return F.when(_remainder(plain) == 1, _bound(_bound(fresh, whole), lambda x: _refilled(m, x)))


MAKERS: dict[str, Callable[[Column, str], Column]] = {
    "mail": _mail,
    "secret": _secret,
    "iban": _iban,
    "access_key": _access_key,
    "ip": _ip,
    "iso_date": _iso_date,
    "day_date": _day_date,
    "ssn": _ssn,
    "local_phone": _local_phone,
    "phone": _phone,
}
KINDS = (*MAKERS, "card")


def hidden(docs: DataFrame, key: str, text: str = "text", into: str = "text", found: str = "found") -> DataFrame:
    """docs with the text column's pseudonymised form in `into` and array<struct<kind,value>> of what was replaced in `found`.

    Null texts stay null with nothing found.  A string that has a shape but doesn't validate stays as
    it is.  All other columns and all rows, repeated ones too, are kept.
    """
    t = F.col(text)
    some = t.rlike(MAY_HOLD)
    spots = F.when(some, F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    rows = docs.withColumn("_spots", F.coalesce(spots, F.array().cast("array<string>")))

    def replaced(m: Column) -> Column:
        kinds = F.lit(None).cast("string")
        for name in reversed(SHAPES):
            kinds = F.when(m.rlike(f"^(?:{SHAPES[name]})$"), "local_phone" if name == "area_phone" else name).otherwise(kinds)

        def made(k: Column) -> Column:
            value = F.lit(None).cast("string")
            for name, maker in MAKERS.items():
                value = F.when(k == name, maker(m, key)).otherwise(value)
            return _piece(m, k, value)

        return F.element_at(F.transform(F.array(kinds), made), 1)

    # Cards are looked for between the other shapes.
    pieces = F.zip_with(
        F.transform(F.split(t, ANY, -1), lambda gap: _card_pieces(gap, key)),
        F.transform("_spots", replaced),
        lambda gap, spot: F.concat(gap, F.when(spot.isNull(), F.array().cast("array<struct<raw:string,kind:string,value:string>>")).otherwise(F.array(spot))),
    )
    rows = rows.withColumn("_made", F.when(some, F.flatten(pieces)))
    fresh = F.when(F.col("_made").isNotNull(), F.array_join(F.transform("_made", lambda x: F.coalesce(x["value"], x["raw"])), "")).otherwise(t)
    kept = F.transform(F.filter("_made", lambda x: x["value"].isNotNull()), lambda x: F.struct(x["kind"], x["value"]))
    return rows.withColumns({into: fresh, found: F.coalesce(kept, F.array().cast("array<struct<kind:string,value:string>>"))}).drop("_spots", "_made")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_found and a count for each kind."""
    rows = hidden(docs.select("doc_id", "text"), key)
    kinds = F.transform("found", lambda x: x["kind"])
    rows = rows.withColumn("kinds", kinds)
    counts = [(F.size("kinds") - F.size(F.array_remove("kinds", k))).alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", "text", F.size("found").alias("n_found"), *counts)


def op3_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(documents(spark, sf_dir), QUERY_KEY)
