"""Operator 4: format-preserving Feistel pseudonyms, in SQL functions only.

Personal values are found by one pattern, validated (Luhn, mod 97, octet and calendar ranges,
area rules) and replaced by a keyed permutation of the same format. The permutation depends on
the key and the value alone, so equal values stay equal in all documents and different values of
a format stay different. Everything else of the text is kept byte for byte.

Two Feistel networks are used. Strings (phones, cards, account numbers, mail names, secrets) are
cut in two halves; in each round the characters of one half are shifted within their alphabet
by a keyed hash of the other half, so that every character keeps its class and separators keep
their place. Integers (dates as day numbers, IPv4 addresses, social security numbers) are split
in two digits of a mixed radix a*b, which is exactly the size of the domain; where some values of
the domain are not valid, the permutation is applied again until the value is valid.

Defined results: null text stays null; empty text stays empty with 0 values; invalid values
(wrong check digit, 30 February, octet 256) are left alone; repeated rows give repeated rows;
other columns, whatever their names, are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS, LOWERS, UPPERS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DEFAULT_KEY = "corpus-pseudonym-key-1"
ROUNDS = 8
#: days 1900-01-01 + 0 .. 72999 (to 2099-11-12): 250 * 292 day numbers
DATE_RADIX = (250, 292)

# a domain has at most 253 characters, so at most 126 labels: the bound keeps the matcher's stack small on any text
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,24}"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = (r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}"
        r"|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![0-9]|[./-][0-9])")
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = (r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?<cs>[ -])[0-9]{4}\k<cs>[0-9]{4}\k<cs>[0-9]{4}"
        r"|[0-9]{4}(?<as>[ -])[0-9]{6}\k<as>[0-9]{5})(?![0-9])")
PHONE = (r"(?:(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}"
         r"|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?<![0-9.-])[0-9]{3}(?<ps>[.-])[0-9]{3}\k<ps>[0-9]{4})(?![0-9])")
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = (r"(?<![A-Za-z0-9])(?:AKIA[A-Z2-7]{16}(?![A-Za-z0-9])"
          r"|(?i:password|passwd|pwd|secret|token|api[_-]?key)[ ]?[=:][ ]?[\x22']?[A-Za-z0-9+/_-]{8,})")
PATTERN = "|".join([EMAIL, IPV4, DATE, SSN, PHONE, IBAN, CARD, SECRET])
SECRET_HEAD = r"^((?i:AKIA|[a-z_-]+[ ]?[=:][ ]?[\x22']?))"
PHONE_HEAD = r"^(\+[0-9]{1,3}[ .-]?\(?[0-9]|\(?[0-9])"


def _q(text: str) -> str:
    """A raw SQL string literal, so that patterns keep their backslashes."""
    return "r'" + text.replace("'", "\\x27") + "'"


def _hash(key: str, tag: str, rnd: str, value: str) -> str:
    return f"sha2(concat({_q(key + '|' + tag + '|')}, {rnd}, '|', {value}), 256)"


def feistel_string_sql(s: str, key: str, tag: str, alphabets: tuple[str, ...], v: str) -> str:
    """SQL for the keyed permutation of string ``s``; characters outside the alphabets stay.
    ``v`` prefixes the names of the lambda variables."""
    char = "case " + " ".join(
        f"when instr('{a}', {v}c) > 0 then substring('{a}', 1 + (instr('{a}', {v}c) - 1 "
        f"+ cast(conv(substring({v}p.h, 1 + 2 * ({v}j % 32), 2), 16, 10) as int)) % {len(a)}, 1)"
        for a in alphabets) + f" else {v}c end"
    # the round's hash is computed once, as the start value of a one-step aggregate
    shifted = (f"aggregate(array(1), named_struct('h', {_hash(key, tag, f'{v}i', f'{v}a.r')}, 't', {v}a.l), ({v}p, {v}u) -> "
               f"named_struct('h', {v}p.h, 't', array_join(transform(filter(split({v}p.t, ''), {v}e -> {v}e <> ''), "
               f"({v}c, {v}j) -> {char}), ''))).t")
    return (f"aggregate(sequence(1, {ROUNDS}), named_struct('l', substring({s}, 1, cast(length({s}) / 2 as int)), "
            f"'r', substring({s}, 1 + cast(length({s}) / 2 as int))), ({v}a, {v}i) -> "
            f"named_struct('l', {v}a.r, 'r', {shifted}), {v}z -> concat({v}z.l, {v}z.r))")


def feistel_int_sql(x: str, a: int, b: int, key: str, tag: str, v: str) -> str:
    """SQL for the keyed permutation of the integers 0 .. a*b-1."""
    f = f"cast(conv(substring({_hash(key, tag, f'{v}i', f'cast(if({v}i % 2 = 1, {v}s.r, {v}s.l) as string)')}, 1, 12), 16, 10) as bigint)"
    return (f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({x} as bigint) div {b}, 'r', cast({x} as bigint) % {b}), "
            f"({v}s, {v}i) -> named_struct('l', if({v}i % 2 = 1, ({v}s.l + {f}) % {a}, {v}s.l), "
            f"'r', if({v}i % 2 = 0, ({v}s.r + {f}) % {b}, {v}s.r)), {v}z -> {v}z.l * {b} + {v}z.r)")


def walk_sql(x: str, a: int, b: int, key: str, tag: str, valid, v: str, steps: int = 64) -> str:
    """Cycle walking: permute until ``valid``. The bound of the steps is never met in practice:
    at least 40% of each domain is valid."""
    once = feistel_int_sql(x, a, b, key, tag, v + "f")
    again = feistel_int_sql(f"{v}y", a, b, key, tag, v + "g")
    return f"aggregate(sequence(1, {steps}), {once}, ({v}y, {v}n) -> if({valid(f'{v}y')}, {v}y, {again}))"


def _fill(template: str, digits: str, v: str) -> str:
    """The digits put into the digit places of a template with separators."""
    return (f"aggregate(filter(split({template}, ''), {v}e -> {v}e <> ''), named_struct('o', '', 'k', 0), ({v}a, {v}c) -> "
            f"if(instr('{DIGITS}', {v}c) > 0, named_struct('o', concat({v}a.o, substring({digits}, {v}a.k + 1, 1)), 'k', {v}a.k + 1), "
            f"named_struct('o', concat({v}a.o, {v}c), 'k', {v}a.k)), {v}z -> {v}z.o)")


def _luhn_sum(payload: str, v: str) -> str:
    """Luhn sum of a payload without its check digit."""
    return (f"aggregate(transform(filter(split(reverse({payload}), ''), {v}e -> {v}e <> ''), ({v}c, {v}j) -> "
            f"if({v}j % 2 = 1, cast({v}c as int), if(cast({v}c as int) > 4, 2 * cast({v}c as int) - 9, 2 * cast({v}c as int)))), "
            f"0, ({v}s, {v}d) -> {v}s + {v}d)")


def _mod97(text: str, v: str) -> str:
    """Remainder by 97 of a string of digits and capitals (A = 10 .. Z = 35)."""
    return (f"aggregate(filter(split({text}, ''), {v}e -> {v}e <> ''), 0, ({v}s, {v}c) -> "
            f"if(instr('{DIGITS}', {v}c) > 0, ({v}s * 10 + cast({v}c as int)) % 97, ({v}s * 100 + ascii({v}c) - 55) % 97))")


def pseudonym_sql(m: str, key: str) -> str:
    """SQL that maps one found value to its pseudonym; an invalid value maps to itself."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    head = f"substring({digits}, 1, length({digits}) - 1)"
    body = f"concat(substring({head}, 1, 1), {feistel_string_sql(f'substring({head}, 2)', key, 'card', (DIGITS,), 'kc')})"
    card_of = (f"aggregate(array(1), {body}, (kb, ku) -> concat(kb, cast((10 - {_luhn_sum('kb', 'kl')} % 10) % 10 as string)))")
    card = (f"if(({_luhn_sum(head, 'kv')} + cast(right({digits}, 1) as int)) % 10 = 0, {_fill(m, card_of, 'kf')}, {m})")

    octet = [f"cast(split({m}, '[.]')[{i}] as bigint)" for i in range(4)]
    ip_int = f"({octet[0]} * 16777216 + {octet[1]} * 65536 + {octet[2]} * 256 + {octet[3]})"
    ip_out = (f"aggregate(array(1), {feistel_int_sql(ip_int, 65536, 65536, key, 'ip', 'ia')}, (io, iu) -> io, iz -> concat_ws('.', "
              "cast(iz div 16777216 as string), cast((iz div 65536) % 256 as string), cast((iz div 256) % 256 as string), "
              "cast(iz % 256 as string)))")
    ip = f"if(greatest({', '.join(octet)}) <= 255, {ip_out}, {m})"

    epoch, (ra, rb) = "date'1900-01-01'", DATE_RADIX

    def dated(fmt: str, order: tuple[int, int, int], v: str, valid=None) -> tuple[str, str]:
        y, mo, d = (f"split({m}, '[./-]')[{i}]" for i in order)
        day = f"datediff(try_to_date(concat_ws('-', {y}, {mo}, {d}), 'yyyy-MM-dd'), {epoch})"
        ok = f"coalesce({day} between 0 and {ra * rb - 1}, false)"
        if valid:
            num = walk_sql(day, ra, rb, key, "date-" + fmt, valid, v)
        else:
            num = feistel_int_sql(day, ra, rb, key, "date", v)
        return ok, f"date_format(date_add({epoch}, cast({num} as int)), '{fmt}')"

    late_day = lambda x: f"dayofmonth(date_add({epoch}, cast({x} as int))) > 12"
    ymd = [(f"{m} rlike '^[0-9]{{4}}{s}'", dated(f"yyyy{s}MM{s}dd", (0, 1, 2), f"d{i}")) for i, s in enumerate("-/")]
    # day first with points; otherwise month first, and day first where the first part can't be a month
    dmy = [(f"{m} rlike '^[0-9]{{2}}[.]'", dated("dd.MM.yyyy", (2, 1, 0), "d2"))]
    for i, s in enumerate("/-"):
        dmy.append((f"{m} rlike '^(0[1-9]|1[0-2]){s}'", dated(f"MM{s}dd{s}yyyy", (2, 0, 1), f"d{3 + i}")))
        dmy.append((f"{m} rlike '^[0-9]{{2}}{s}'", dated(f"dd{s}MM{s}yyyy", (2, 1, 0), f"d{5 + i}", late_day)))
    date = "case " + " ".join(f"when {cond} then if({ok}, {out}, {m})" for cond, (ok, out) in ymd + dmy) + f" else {m} end"

    ssn_int = f"cast(regexp_replace({m}, '-', '') as bigint)"

    def ssn_ok(x: str) -> str:
        return (f"(({x}) div 1000000 not in (0, 666) and ({x}) div 1000000 < 900 and (({x}) div 10000) % 100 > 0 "
                f"and ({x}) % 10000 > 0)")

    ssn = (f"if({ssn_ok(ssn_int)}, aggregate(array(1), lpad(cast({walk_sql(ssn_int, 31250, 32000, key, 'ssn', ssn_ok, 'sw')} as string), 9, '0'), "
           f"(so, su) -> so, sz -> concat(substring(sz, 1, 3), '-', substring(sz, 4, 2), '-', substring(sz, 6))), {m})")

    phone_head = f"regexp_extract({m}, {_q(PHONE_HEAD)}, 1)"
    phone = (f"if(length({digits}) between 7 and 15, concat({phone_head}, "
             f"{feistel_string_sql(f'substring({m}, 1 + length({phone_head}))', key, 'phone', (DIGITS,), 'p')}), {m})")

    plain = f"replace({m}, ' ', '')"
    account = feistel_string_sql(f"substring({plain}, 5)", key, "iban", (DIGITS, UPPERS), "bf")
    iban_of = (f"aggregate(array(1), {account}, (ba, bu) -> concat(substring({plain}, 1, 2), lpad(cast(98 - "
               f"{_mod97(f'''concat(ba, substring({plain}, 1, 2), '00')''', 'bm')} as string), 2, '0'), ba))")
    spaced = (f"aggregate(filter(split({m}, ''), be -> be <> ''), named_struct('o', '', 'k', 0), (bs, bc) -> "
              f"if(bc = ' ', named_struct('o', concat(bs.o, ' '), 'k', bs.k), "
              f"named_struct('o', concat(bs.o, substring({iban_of}, bs.k + 1, 1)), 'k', bs.k + 1)), bz -> bz.o)")
    iban = f"if({_mod97(f'concat(substring({plain}, 5), substring({plain}, 1, 4))', 'bv')} = 1, {spaced}, {m})"

    user = f"substring_index({m}, '@', 1)"
    mail = (f"concat({feistel_string_sql(user, key, 'mail', (DIGITS, LOWERS, UPPERS), 'm')}, "
            f"substring({m}, 1 + length({user})))")

    secret_head = f"regexp_extract({m}, {_q(SECRET_HEAD)}, 1)"
    value = f"substring({m}, 1 + length({secret_head}))"
    secret = ("case " + " ".join(
        f"when {value} rlike '^[{cls}]*$' then concat({secret_head}, {feistel_string_sql(value, key, 'secret', alph, v)})"
        for cls, alph, v in (("0-9a-f", ("0123456789abcdef",), "h"), ("A-Z2-7", (UPPERS + "234567",), "g"))) +
        f" else concat({secret_head}, {feistel_string_sql(value, key, 'secret', (DIGITS, LOWERS, UPPERS), 'w')}) end")

    return (f"case when {m} like '%@%' then {mail} "
            f"when {m} rlike {_q('^(?:' + IPV4 + ')$')} then {ip} "
            f"when {m} rlike {_q('^(?:' + DATE + ')$')} then {date} "
            f"when {m} rlike {_q('^(?:' + SSN + ')$')} then {ssn} "
            f"when {m} rlike {_q('^(?:' + CARD + ')$')} and length({digits}) >= 13 then {card} "
            f"when {m} rlike '^[+(0-9]' then {phone} "
            f"when {m} rlike {_q('^(?:' + IBAN + ')$')} then {iban} "
            f"else {secret} end")


def pseudonymise(df: DataFrame, text: str = "text", key: str = DEFAULT_KEY, out: str | None = None,
                 count: str | None = None) -> DataFrame:
    """``df`` with the personal values of column ``text`` replaced (into ``out``, by default the
    same column) and, if ``count`` is given, the number of values that were replaced."""
    t: Column = F.col(text)
    kind = t.rlike("[0-9@=:]|AKIA")  # cheap test that every match of PATTERN passes: most texts hold no candidate at all
    found = F.when(kind, F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    one = df.withColumn("_pii_found", found)
    named = F.expr(f"transform(_pii_found, pii_m -> {pseudonym_sql('pii_m', key)})")
    two = one.withColumn("_pii_named", F.when(F.size("_pii_found") > 0, named).otherwise(F.array().cast("array<string>")))
    gaps = F.split(t, PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, F.col("_pii_named"), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("_pii_found", "_pii_named", lambda a, b: a != b), lambda x: x))
    res = two.withColumn("_pii_text", F.when(F.size("_pii_found") > 0, joined).otherwise(t))
    if count:
        res = res.withColumn(count, F.when(t.isNull(), F.lit(0)).otherwise(changed).cast("long"))
    return res.withColumn(out or text, F.col("_pii_text")).drop("_pii_found", "_pii_named", "_pii_text")
