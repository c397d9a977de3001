"""Barcode functions as Column expressions: no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def hamming(a: Column, b: Column) -> Column:
    """Differing places over the common length; surplus of the longer string is ignored."""
    places = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    differ = F.aggregate(places, F.lit(0), lambda s, i: s + F.when(F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)), 1).otherwise(0))
    return F.when(F.least(F.length(a), F.length(b)) == 0, 0).otherwise(differ)


def hamming_strict(a: Column, b: Column) -> Column:
    """Hamming distance; strings of unequal length are as far apart as the longer is long."""
    return F.when(F.length(a) == F.length(b), hamming(a, b)).otherwise(F.greatest(F.length(a), F.length(b)))


def pack(umi: Column) -> Column:
    """Barcode of up to 31 bases in two bits each."""
    return F.conv(F.translate(umi, BASES, "0123"), 4, 10).cast("long")


def packed_hamming(x: Column, y: Column) -> Column:
    d = x.bitwiseXOR(y)
    return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def one_hot(umi: Column) -> Column:
    """Four numbers a base; unknown bases count as G."""
    row = lambda c: F.array(*((c == b if b != "G" else ~c.isin("A", "C", "T")).cast("int") for b in BASES))
    return F.flatten(F.transform(_chars(umi), row))


def blocks(umi: Column, k: int = 3) -> Column:
    """Whole blocks of ``k`` bases."""
    n = F.floor(F.length(umi) / k).cast("int")
    empty = F.array().cast("array<string>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substr(umi, i * k + 1, F.lit(k)))).otherwise(empty)


def _count(block: Column, base: Column) -> Column:
    return F.length(block) - F.length(F.replace(block, base, F.lit("")))


def vote(block: Column, tie: Column | None = None) -> Column:
    """Most frequent base; among equals the first, or the ``tie``-th."""
    chars = _chars(block)
    most = F.array_max(F.transform(chars, lambda c: _count(block, c)))
    best = F.array_distinct(F.filter(chars, lambda c: _count(block, c) == most))
    return F.element_at(best, (F.pmod(tie, F.size(best)) + 1).cast("int")) if tie is not None else F.element_at(best, 1)


def majority_vote(umi: Column, k: int = 3, seed: int | None = None) -> Column:
    """Monomer by votes in the blocks. Ties give the first base, or a seeded choice."""
    if seed is None:
        return F.array_join(F.transform(blocks(umi, k), lambda b: vote(b)), "")
    return F.array_join(F.transform(blocks(umi, k), lambda b, i: vote(b, F.xxhash64(umi, i, F.lit(seed)))), "")


def take_by_order(umi: Column, place: int = 0, k: int = 3) -> Column:
    """The base at ``place`` of each block."""
    return F.array_join(F.transform(blocks(umi, k), lambda b: F.substr(b, F.lit(place + 1), F.lit(1))), "")


def _product(choices: Column) -> Column:
    return F.array_sort(F.array_distinct(F.aggregate(choices, F.array(F.lit("")), lambda acc, bases: F.flatten(F.transform(acc, lambda p: F.transform(bases, lambda b: F.concat(p, b)))))))


def split_to_all(umi: Column, k: int = 3) -> Column:
    """Sorted monomers from every distinct base of each block."""
    return _product(F.transform(blocks(umi, k), lambda b: F.array_distinct(_chars(b))))


def vote_set(block: Column) -> Column:
    """Most frequent bases of a block, all of them if they tie."""
    chars = _chars(block)
    most = F.array_max(F.transform(chars, lambda c: _count(block, c)))
    return F.array_distinct(F.filter(chars, lambda c: _count(block, c) == most))


def split_by_vote(umi: Column, k: int = 3) -> Column:
    """Sorted monomers from the voted bases of each block."""
    return _product(F.transform(blocks(umi, k), vote_set))


def expand(umi: Column, k: int = 3) -> Column:
    """Each base repeated ``k`` times; blank is null."""
    return F.nullif(F.array_join(F.transform(_chars(F.trim(umi)), lambda c: F.repeat(c, F.lit(k))), ""), F.lit(""))


def expand_checked(umi: Column, length: int = 8) -> Column:
    """``expand`` by three of a barcode that must have ``length`` IUPAC bases."""
    s = F.upper(F.trim(umi))
    return F.when(s.isNull() | (s == ""), None).when((F.length(s) == length) & s.rlike("^[ACGTURYSWKMBDHVN]*$"), expand(s)).otherwise(F.raise_error(F.concat(F.lit("not a barcode: "), umi)).cast("string"))


def strand(umi: Column, place: int, k: int) -> Column:
    """One of the interleaved copies of a multimer, by place in the block."""
    return take_by_order(umi, place, k)


def has_conflict(umi: Column, distinct: int = 3, k: int = 3) -> Column:
    """Whether any block has as many distinct bases."""
    return F.exists(blocks(umi, k), lambda b: F.size(F.array_distinct(_chars(b))) >= distinct)


def correct_dimer(umi: Column, seed: int | None = None) -> Column:
    """Monomer of a homodimer; blocks in conflict give the first base or a seeded choice."""
    return majority_vote(umi, 2, seed)


def draw(*key: Column | str | int) -> Column:
    """A number in (0, 1] from the MD5 of the key's parts, joined by slashes: equal wherever it is drawn again."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    hexed = F.substring(F.md5(F.concat_ws("/", *parts).cast("binary")), 1, 13)
    return (F.conv(hexed, 16, 10).cast("long") + 1).cast("double") / float(1 << 52)


def _place(umi: Column, i: Column, what: str, seed: int, n: int) -> Column:
    """A drawn place from 1 to ``n``."""
    return F.ceil(draw(umi, i, what, seed) * n).cast("int")


def substitute(umi: Column, rate: float, seed: int) -> Column:
    """Each base replaced by another one with probability ``rate``."""
    other = lambda c, i: F.substr(F.replace(F.lit(BASES), c, F.lit("")), _place(umi, i, "base", seed, 3), F.lit(1))
    return F.array_join(F.transform(_chars(umi), lambda c, i: F.when(draw(umi, i, "sub", seed) < rate, other(c, i)).otherwise(c)), "")


def delete(umi: Column, rate: float, seed: int) -> Column:
    return F.array_join(F.transform(_chars(umi), lambda c, i: F.when(draw(umi, i, "del", seed) < rate, F.lit("")).otherwise(c)), "")


def insert(umi: Column, rate: float, seed: int) -> Column:
    new = lambda i: F.substr(F.lit(BASES), _place(umi, i, "new", seed, 4), F.lit(1))
    return F.array_join(F.transform(_chars(umi), lambda c, i: F.when(draw(umi, i, "ins", seed) < rate, F.concat(c, new(i))).otherwise(c)), "")


# error model of homotrimer barcodes
def block_error(p: Column) -> Column:
    """Probability that a vote over three bases fails or ties to the wrong one."""
    return F.lit(7.0) / 3 * p * p * (1 - p) + p * p * p


def bitflip_error(p: Column) -> Column:
    return 3 * p * p - 2 * p * p * p


def barcode_error(e: Column, n: int) -> Column:
    """Probability that any of ``n`` independent places is wrong."""
    return 1 - F.pow(1 - e, F.lit(float(n)))


def digitize(value: Column, borders: list[float]) -> Column:
    """Number of borders that are not above the value."""
    return F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b <= value))


def loss_probability(threshold: Column, mean: Column) -> Column:
    """Poisson probability of fewer than ``threshold`` reads, clipped to [0, 1]."""
    term = lambda s, k: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * mean / (k + 1)).alias("term"))
    start = F.struct(F.lit(0.0).alias("sum"), F.exp(-mean).alias("term"))
    total = F.aggregate(F.sequence(F.lit(0), F.greatest(threshold, F.lit(1)).cast("int") - 1), start, term, lambda s: s["sum"])
    return F.when(threshold <= 0, 0.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def collision_corrected(k: Column, m: float) -> Column:
    """Molecules behind ``k`` distinct barcodes of ``m`` possible ones."""
    return F.when(k < m, -m * F.log(1 - k / m)).otherwise(float("inf"))


def logistic(x: Column, top: float, rate: float, middle: float) -> Column:
    return top / (1 + F.exp(-rate * (x - middle)))


def number_to_umi(k: Column, length: int) -> Column:
    """Barcode whose i-th base is the i-th base-4 digit of ``k``, lowest first."""
    digit = lambda i: F.pmod(F.floor(k / float(4**i)).cast("long"), F.lit(4)).cast("int") + 1
    return F.concat(*(F.substr(F.lit(BASES), digit(i), F.lit(1)) for i in range(length)))
