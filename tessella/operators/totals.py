"""Totals of groups whose float sums are exact: they don't depend on the order of rows or on how these are dealt to tasks.

A float is a whole number times a power of two. Powers are cut into bins of 34, so a bin's whole numbers have at most 88 bits.
They are cut into four of 22 bits, and a long adds up 2^40 of these; decimals of 38 digits put the sums together, one for each
group. Three bins make a window; the usual floats of a column lie
in one. Rows are aggregated by group and window, combined before the shuffle, then the windows of each group are added and
rounded once; windows whose items cancel are left out. All of it is columns of decimals, given as text, which is analysed in one go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Power of the lowest bin of window 0, powers in a bin, bins in a window. Floats of about 2^-33 to 2^69 are in window 0.
LOW, BIN, BINS = -86, 34, 3
WINDOW = BIN * BINS
#: Bits in the lower half of a bin's whole number, and in a quarter of it.
HALF, QUARTER = 44, 22
WIDE = "decimal(38,0)"
ZERO = f"cast(0 as {WIDE})"


def scaled(value: str, exponent: str) -> str:
    """value * 2^exponent in two steps, as a power of its own may not fit."""
    half = f"floor(({exponent}) / 2)"
    return f"({value}) * pow(2d, {half}) * pow(2d, ({exponent}) - {half})"


def finite(value: str, what: str) -> str:
    return f"CASE WHEN isnan({value}) OR abs({value}) = double('Infinity') THEN cast(raise_error('{what} is not finite') AS double) ELSE {value} END"


def bins(n: int) -> list[str]:
    """The window of float `_x<n>`, its bin there, and the upper and lower half of its whole number. One bit below the float's last one leaves room for
    the logarithm's rounding."""
    return [
        f"coalesce(floor(log2(abs(_v{n}))) - 53 - {LOW}, 0) AS _r{n}",
        f"cast(floor(_r{n} / {WINDOW}) AS int) AS _w{n}",
        f"cast(floor(pmod(_r{n}, {WINDOW}) / {BIN}) AS int) AS _b{n}",
        f"{scaled(f'_v{n}', f'-({LOW} + _w{n} * {WINDOW} + _b{n} * {BIN})')} AS _y{n}",
        f"floor(_y{n} / {2**HALF}d) AS _h{n}",
        f"cast(_y{n} - _h{n} * {2**HALF}d AS bigint) AS _m{n}",
    ]


def quarters(n: int) -> list[str]:
    """A bin's whole number in four, lowest first; the last has the sign."""
    part = lambda c: (f"{c}{n} & {2**QUARTER - 1}L", f"shiftright({c}{n}, {QUARTER})")
    return [*part("_m"), *part("_h")]


def carried(digits: str) -> str:
    """(digits from 0 to 2^34 - 1, what is left above them) of bins in rising order."""
    start = f"named_struct('digits', cast(array() AS array<{WIDE}>), 'over', {ZERO})"
    digit, whole = f"cast(pmod(s + a.over, {2**BIN}BD) AS {WIDE})", "s + a.over"
    return f"aggregate({digits}, {start}, (a, s) -> named_struct('digits', concat(a.digits, array({digit})), 'over', cast(({whole} - {digit}) / {2**BIN}BD AS {WIDE})))"


def rounded(n: int) -> list[str]:
    """`_f<n>` and `_e<n>`: the sum of the windows `_l<n>`, an array of (w, s0, s1, s2), rounded to a float _f times 2^_e."""
    one = f"coalesce(get(_l{n}, 0), named_struct('w', 0, {', '.join(f"'s{i}', {ZERO}" for i in range(BINS))}))"
    ws = f"transform(_l{n}, x -> x.w)"
    near = f"size(_l{n}) <= 1 AND abs({one}.s2) < {2**40}BD AND abs({one}.s1) < {2**70}BD AND abs({one}.s0) < {2**100}BD"
    short = f"cast(cast({one}.s2 AS decimal(13,0)) * {2 ** (2 * BIN)}BD + cast({one}.s1 AS decimal(22,0)) * {2**BIN}BD AS {WIDE}) + {one}.s0"
    of = lambda i: f"aggregate(filter(_l{n}, x -> x.w = w), {ZERO}, (a, x) -> cast(a + x.s{i} AS {WIDE}))"
    # Two windows on top take what sums carry over.
    every = f"flatten(transform(sequence(array_min({ws}), array_max({ws}) + 2), w -> array({', '.join(map(of, range(BINS)))})))"
    top = f"slice(_d{n}, greatest(_p{n}, 1), 3)"
    return [
        f"{near} AS _near{n}",
        f"CASE WHEN NOT _near{n} THEN {every} END AS _bins{n}",
        f"CASE WHEN {carried(f'_bins{n}')}.over < 0 THEN -1 ELSE 1 END AS _sign{n}",
        f"reverse({carried(f'transform(_bins{n}, x -> cast(x * _sign{n} AS {WIDE}))')}.digits) AS _d{n}",
        f"cast(array_position(transform(_d{n}, x -> x > 0), true) AS int) AS _p{n}",
        f"aggregate({top}, {ZERO}, (a, x) -> cast(a * {2**BIN}BD + x AS {WIDE})) AS _top{n}",
        # Bits below only matter by being there: the lowest bit of the upper ones, more than 53, says so.
        f"cast(exists(slice(_d{n}, _p{n} + 3, size(_d{n})), x -> x > 0) AND _top{n} % 2 = 0 AS int) AS _rest{n}",
        f"CASE WHEN _near{n} THEN cast({short} AS double) WHEN _p{n} = 0 THEN 0d ELSE cast(_top{n} + _rest{n} AS double) * _sign{n} END AS _f{n}",
        f"CASE WHEN _near{n} THEN {LOW} + {one}.w * {WINDOW} ELSE {LOW} + array_min({ws}) * {WINDOW} + (size(_d{n}) - _p{n} + 1 - size({top})) * {BIN} END AS _e{n}",
    ]


#: Reducers that aren't floats: how rows are reduced to windows, and windows to groups.
PLAIN = {
    "count": (F.count, F.sum),
    "rows": (lambda c: F.count(F.lit(1)), F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
    "long_sum": (lambda c: F.sum(F.col(c).cast(WIDE)), F.sum),
}


def totals(df: DataFrame, keys: list[str], reducers: dict[str, tuple[str, Column | str]]) -> DataFrame:
    """One row per key (null is a key; without keys one row for the table) with a column for each reducer (kind, value):
    "sum" and "avg" of floats, exact and rounded once; "count" of items that are there, "rows", "min", "max"; "long_sum".

    A sum without items is 0, an average null. NaN and infinite items are errors, and so is a sum that no float holds; an
    average stays finite where its sum doesn't. A sum of whole numbers beyond a long is an error.
    """
    values = {name: F.col(v) if isinstance(v, str) else v for name, (_, v) in reducers.items()}
    kinds = {name: (i, kind) for i, (name, (kind, _)) in enumerate(reducers.items())}
    # A sum and an average of one column share its windows.
    given = [(isinstance(v, str), v if isinstance(v, str) else None) for _, v in reducers.values()]
    of, floats = {}, []
    for name, (i, kind) in kinds.items():
        if kind in ("sum", "avg"):
            value = reducers[name][1]
            of[i] = next((j for j in floats if isinstance(value, str) and given[j] == (True, value)), i)
            floats += [i] if of[i] == i else []
    others = [(i, *PLAIN[kind]) for i, kind in kinds.values() if kind in PLAIN]
    named = [F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)]
    ks = [f"_k{j}" for j in range(len(keys))]
    rows = df.select(*named, *[v.cast("double").alias(f"_x{i}") if i in of else v.alias(f"_o{i}") for (i, _), v in zip(kinds.values(), values.values(), strict=True) if of.get(i, i) == i])
    rows = rows.selectExpr("*", *[x for n in floats for x in (f"{finite(f'_x{n}', 'an item of a sum')} AS _v{n}", *bins(n))])
    sums = [F.expr(f"sum(CASE WHEN _b{n} = {i} THEN {q} ELSE 0L END)").alias(f"_q{j}_{i}_{n}") for n in floats for i in range(BINS) for j, q in enumerate(quarters(n))]
    sums += [F.count(f"_x{n}").alias(f"_n{n}") for n in floats]
    made = rows.groupBy(*ks, *[f"_w{n}" for n in floats]).agg(*sums, *[first(f"_o{i}").alias(f"_o{i}") for i, first, _ in others])

    def windows(n: int) -> Column:
        """The windows of a group that have a sum; a quarter that is null counts no item."""
        whole = [F.expr(" + ".join(f"cast(coalesce(_q{j}_{i}_{n}, 0L) AS decimal(19,0)) * {2 ** (j * QUARTER)}BD" for j in range(4))).cast(WIDE).alias(f"s{i}") for i in range(BINS)]
        there = F.expr(" OR ".join(f"_q{j}_{i}_{n} <> 0" for i in range(BINS) for j in range(4)))
        return F.collect_list(F.when(there, F.struct(F.col(f"_w{n}").alias("w"), *whole))).alias(f"_l{n}")

    made = made.groupBy(*ks).agg(*[windows(n) for n in floats], *[F.sum(f"_n{n}").alias(f"_n{n}") for n in floats], *[again(f"_o{i}").alias(f"_o{i}") for i, _, again in others])
    made = made.selectExpr("*", *[x for n in floats for x in rounded(n)]) if floats else made

    def result(i: int, kind: str) -> Column:
        i = of.get(i, i)
        if kind == "sum":
            return F.expr(f"CASE WHEN coalesce(_n{i}, 0) = 0 THEN 0d ELSE {finite(scaled(f'_f{i}', f'_e{i}'), 'a sum')} END")
        if kind == "avg":
            return F.expr(f"CASE WHEN _n{i} > 0 THEN {scaled(f'_f{i} / _n{i}', f'_e{i}')} END")
        return F.col(f"_o{i}") if kind in ("min", "max") else F.coalesce(F.col(f"_o{i}"), F.lit(0)).cast("long")

    return made.select(*[F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)], *[result(*kinds[name]).alias(name) for name in reducers])
