"""A seeded generator whose nth draw is a function of (seed, n), and noise drawn from it.

The state of the 32-bit generator moves by a constant, so draws need no order and run anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = 0x6D2B79F5
_WORD = 0xFFFFFFFF
# Neighbouring keys by letter, tokens of junk, and words of junk texts.
NEIGHBOURS = {
    "a": "sq", "b": "vn", "c": "xv", "d": "sf", "e": "wr", "f": "dg", "g": "fh", "h": "gj", "i": "uo", "j": "hk", "k": "jl", "l": "k", "m": "n",
    "n": "bm", "o": "ip", "p": "o", "q": "w", "r": "et", "s": "ad", "t": "ry", "u": "yi", "v": "cb", "w": "qe", "x": "zc", "y": "tu", "z": "x",
}
JUNK_TOKENS = ["asdf", "qwe!!", "zzkx", "lol", "###", "...", "xD", "1234", "~~", "hmm??", "plz", "@@"]
JUNK_WORDS = (
    "fever pain appointment bill doctor cough rash waitlist refund headache medicine booking reminder eyes throat sleep chest account invoice clinic"
).split()


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _let(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once; without this each use would repeat the whole expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _multiply(a: Column, b: Column) -> Column:
    """The low 32 bits of a product; the halves keep every step within a long."""

    def product(x: Column, y: Column) -> Column:
        return F.pmod(F.shiftleft(F.pmod(F.shiftright(x, 16) * y, _long(1 << 16)), 16) + x.bitwiseAND(_long(0xFFFF)) * y, _long(1 << 32))

    return _let(a, lambda x: _let(b, lambda y: product(x, y)))


def _fold(x: Column, bits: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, bits))


def draw(seed: Column | int, n: Column) -> Column:
    """The nth draw (from 1) of ``seed``, at least 0 and under 1."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    state = F.pmod(F.pmod(seed.cast("long"), _long(1 << 32)) + F.pmod(n.cast("long"), _long(1 << 32)) * _long(_STEP), _long(1 << 32))
    first = _let(state, lambda a: _multiply(_fold(a, 15), a.bitwiseOR(_long(1))))
    second = _let(first, lambda t: t.bitwiseXOR(F.pmod(t + _multiply(_fold(t, 7), t.bitwiseOR(_long(61))), _long(1 << 32))))
    return _let(second, lambda t: _fold(t, 14)) / float(_WORD + 1)


def integer(seed: Column | int, n: Column, low: int, high: int) -> Column:
    """From ``low`` to ``high``, both included."""
    return (F.floor(draw(seed, n) * (high - low + 1)) + low).cast("int")


def pick(seed: Column | int, n: Column, items: Column) -> Column:
    return F.get(items, F.floor(draw(seed, n) * F.size(items)).cast("int"))


def shuffle(seed: Column | int, items: Column) -> Column:
    """``items`` in the order that swapping each place, from the last on, with a drawn one up to it gives: the nth swap takes the nth draw."""

    def whole(x: Column) -> Column:
        size = F.size(x)

        def swapped(a: Column, n: Column) -> Column:
            i = size - n
            return _let(F.floor(draw(seed, n) * (i + 1)), lambda j: F.transform(a, lambda v, k: F.when(k == i, F.get(a, j.cast("int"))).when(k == j, F.get(a, i)).otherwise(v)))

        return F.when(size > 1, F.aggregate(F.sequence(F.lit(1), size - 1), x, swapped)).otherwise(x)

    return _let(items, whole)


def typo_word(word: Column, seed: Column, n: Column) -> Column:
    """``word`` with one slip: two letters swapped, one lost, one doubled or a neighbouring key; uses draws n to n + 2.

    Words of fewer than four letters stay, and so does the first letter and, but for swaps, the last.
    """
    size = F.length(word)
    keys = F.create_map(*[F.lit(x) for pair in NEIGHBOURS.items() for x in pair])

    def slip(x: Column) -> Column:
        i, how = x["i"], x["how"]  # i counts from 1
        before, at, after = F.substring(word, F.lit(1), i - 1), F.substring(word, i, F.lit(1)), F.substring(word, i + 1, size)
        neighbour = _let(F.try_element_at(keys, F.lower(at)), lambda near: F.substring(near, F.floor(draw(seed, n + 2) * F.length(near)).cast("int") + 1, F.lit(1)))
        return (
            F.when(how == 0, F.concat(before, F.substring(after, 1, 1), at, F.substring(after, F.lit(2), size)))
            .when(how == 1, F.concat(before, after))
            .when(how == 2, F.concat(before, at, at, after))
            .otherwise(F.coalesce(F.concat(before, neighbour, after), word))
        )

    place = (F.floor(draw(seed, n) * (size - 2)) + 2).cast("int")
    return F.when(size < 4, word).otherwise(_let(F.struct(place.alias("i"), F.floor(draw(seed, n + 1) * 4).cast("int").alias("how")), slip))


def add_typos(text: Column, seed: Column, rate: float) -> Column:
    """Each word slips with chance ``rate``; word i uses draws 4 i + 1 to 4 i + 4 of ``seed``."""
    slipped = F.transform(F.split(text, " "), lambda w, i: F.when(draw(seed, 4 * i + 1) < rate, typo_word(w, seed, 4 * i + 2)).otherwise(w))
    return F.array_join(slipped, " ")


def add_junk(text: Column, seed: Column, count: int) -> Column:
    """``count`` junk tokens put in at random places; token k uses draws -2 k - 1 and -2 k - 2 of ``seed``."""
    junk = F.array(*[F.lit(x) for x in JUNK_TOKENS])

    def put(parts: Column, k: Column) -> Column:
        at = F.floor(draw(seed, -2 * k - 1) * (F.size(parts) + 1)).cast("int")
        return F.concat(F.slice(parts, F.lit(1), at), F.array(pick(seed, -2 * k - 2, junk)), F.slice(parts, at + 1, F.size(parts)))

    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(count - 1)), F.split(text, " "), put), " ")
