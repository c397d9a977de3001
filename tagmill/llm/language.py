"""Language identification by Bayesian fusion of text, markup, address and host evidence.

Text: byte trigrams of the lower-cased text with a blank for each run of ASCII digits, hashed into a table of log likelihoods that
is trained on a bounded sample of texts of known language; every trigram of every text
is read. Markup: the declared language, through a confusion table of declared and text
language. Address: the host's prior is smoothed towards its suffix, the suffix's towards
all rows. The tables are grouped aggregations of the text posteriors (in millionths, so
sums are exact in any order); a row's own part is left out of its host's and suffix's
counts. A class "und" of even trigrams takes texts of no known language.

A row is kept if a known language has a posterior of at least ``accept`` and the text
has a letter.

Hosts are joined by broadcast up to a checked number. Above it the hosts with a
thousandth of all rows or more (a thousand at most) are broadcast and the others are
joined by shuffle, so no hot host is one task's; counts are summed before they are dealt.

Training takes whole texts of each language by id hash, at most ``per_language`` of them
and ``language_bytes`` bytes together (a text that does not fit is passed over).

Defined cases: null, empty and letterless texts are "und", p 1, not kept; null urls and
hosts share the evidence of the null host, null or unknown declarations give none; with
no training text every row is "und"; a very long text is read block by block; repeated
rows are rows; empty tables give no rows; other columns named in ``carry`` come back
unchanged, whatever their names (but lang, p and kept, which are an error), the rest is
ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tagmill.llm.common import lean, settle, text_batches

PER_LANGUAGE = 1500
#: Bytes of the texts that train one language.
LANGUAGE_BYTES = 8 << 20
#: Languages of a broadcast model at most, each of 256 KB; more raise an error.
LANGUAGES = 512
BITS = 16
#: Trigrams overlap: each byte is told three times.
TEMPER = 1 / 3
UNKNOWN_PRIOR = 0.001
SUFFIX_WEIGHT, HOST_WEIGHT, DECLARED_WEIGHT = 20.0, 5.0, 5.0
ACCEPT = 0.5
MILLION = 1_000_000
BROADCAST_HOSTS = 50_000
#: A host with this part of all rows is broadcast however many hosts there are.
HOT_PART = 1000
BLOCK = 1 << 20
#: Elements whose content is no text of the page.
_DROPPED = ("script", "style", "nav", "header", "footer", "aside", "noscript")
_OPEN = re.compile(rf"(?i)<({'|'.join(_DROPPED)})\b")
_CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in _DROPPED}
#: Digits tell no language; what stands beside them is read.
_DIGITS = re.compile(r"[0-9]+")
_LETTER = re.compile(r"[^\W\d_]")


def page_text(html: str) -> str:
    """Visible text of a page, without navigation and scripts, in one pass.

    What is never closed is looked for once: an open element or comment without an end is
    a tag like any other, a "<" without a ">" is text.
    """
    out, at, unclosed = [], 0, set()
    while (i := html.find("<", at)) >= 0:
        out.append(html[at:i])
        end = -1
        if html.startswith("<!--", i) and "comment" not in unclosed:
            end = html.find("-->", i + 4) + 2
            if end == 1:
                end = -1
                unclosed.add("comment")
        elif (opened := _OPEN.match(html, i)) and (name := opened[1].lower()) not in unclosed:
            closed = _CLOSE[name].search(html, opened.end())
            if closed:
                end = closed.end() - 1
            else:
                unclosed.add(name)
        if end < 0:
            end = html.find(">", i)
        if end < 0:
            at = i
            break
        out.append(" ")
        at = end + 1
    out.append(html[at:])
    return html_lib.unescape("".join(out))


def trigrams(text: str):
    """Hashed byte trigrams, in blocks."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    for i in range(0, max(len(data) - 2, 0), BLOCK):
        part = data[i : i + BLOCK + 2]
        yield ((part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def train(samples: Iterable[tuple[str, str]]) -> dict:
    """Table of log likelihoods from (language, text), as plain data."""
    counts: dict[str, np.ndarray] = {}
    for lang, text in samples:
        own = counts.setdefault(lang, np.full(1 << BITS, 0.5))
        for grams in trigrams(_DIGITS.sub(" ", text)):
            own += np.bincount(grams, minlength=1 << BITS)
    names = sorted(counts)
    table = np.empty((1 << BITS, len(names)), np.float32)
    for i, name in enumerate(names):
        table[:, i] = np.log(counts[name] / counts[name].sum())
    return {"names": names, "table": table}


def training_texts(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, language_bytes: int = LANGUAGE_BYTES, languages: int = LANGUAGES
) -> Iterator[tuple[str, str]]:
    """Texts of each language by id hash within both bounds; over ``languages`` languages raise an error.

    The texts come to the driver a partition at a time.
    """
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    if known.select("l").distinct().limit(languages + 1).count() > languages:
        raise ValueError(f"more than {languages} languages")
    by_hash = W.partitionBy("l").orderBy("h", F.col("k").asc_nulls_last())
    chosen = known.select("l", "k", F.xxhash64("k").alias("h")).distinct().withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= per_language).drop("r")
    # at most ``per_language`` ids a language
    found = known.where(F.octet_length("t") <= language_bytes).join(F.broadcast(chosen.withColumnsRenamed({"l": "l2", "k": "k2"})), (F.col("l") == F.col("l2")) & F.col("k").eqNullSafe(F.col("k2")))
    texts = found.groupBy("l", "h", "k").agg(F.min("t").alias("t"))
    upto = F.sum(F.octet_length("t")).over(by_hash)
    for row in texts.withColumn("upto", upto).where(F.col("upto") <= language_bytes).select("l", "t").toLocalIterator():
        yield row["l"], row["t"]


def sample(docs: DataFrame, **options) -> list[tuple[str, str]]:
    """The ``training_texts`` all at once."""
    return list(training_texts(docs, **options))


def _carried(carry: list[str]) -> Column:
    """The carried columns as one, so that their names meet no other."""
    if clash := {"lang", "p", "kept"} & {c.lower() for c in carry}:
        raise ValueError(f"carried columns may not be named {sorted(clash)}")
    return F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), F.lit(0).alias("none")).alias("carry")


def text_evidence(rows: DataFrame, model: dict, *, is_html: bool = False) -> DataFrame:
    """All columns of ``rows`` but the last, ``text``, and p: posterior of each language and of "und" from the text alone, in millionths."""
    spark = rows.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = StructType([*rows.schema.fields[:-1], StructField("p", ArrayType(LongType()))])
    even = -BITS * np.log(2)

    def run(batches):
        table, size = shared.value["table"], len(shared.value["names"])
        for batch in batches:
            out = []
            for value in batch.column(batch.num_columns - 1):
                value = value.as_py() or ""
                value = _DIGITS.sub(" ", page_text(value) if is_html else value)
                score = np.full(size + 1, np.log(1 - UNKNOWN_PRIOR) - np.log(max(size, 1)))
                score[size] = np.log(UNKNOWN_PRIOR)
                if not size or not _LETTER.search(value):
                    score[:size] = -np.inf
                else:
                    for grams in trigrams(value):
                        score[:size] += TEMPER * table[grams].sum(axis=0, dtype=np.float64)
                        score[size] += TEMPER * even * len(grams)
                p = np.exp(score - score.max())
                out.append(np.rint(p / p.sum() * MILLION).astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.int64()))], schema.names)

    return rows.mapInArrow(lean(run), schema)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def declared_in(html: Column) -> Column:
    """Primary tag of the markup's language, lower-cased; null without one."""
    tag = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)
    return F.nullif(F.lower(tag), F.lit(""))


def fuse(evidence: DataFrame, names: list[str], *, carry: list[str], accept: float = ACCEPT, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """The carried columns, lang, p and kept from evidence with carry, host, suffix, declared and p."""
    back = [F.col(f"carry.c{i}").alias(c) for i, c in enumerate(carry)]
    if not names:
        return evidence.select(*back, F.lit("und").alias("lang"), F.lit(1.0).alias("p"), F.lit(False).alias("kept"))
    size = len(names)
    each = range(size)
    sums = [F.sum(F.col("p")[i]).alias(f"n{i}") for i in each]
    add = lambda df, *by: df.groupBy(*by).agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in each))
    hosts = settle(evidence.groupBy("host", "suffix").agg(*sums, F.count("*").alias("rows")))
    suffixes = add(hosts, "suffix")
    world = add(suffixes).first()
    world = [world[f"n{i}"] or 0 for i in each]
    total = sum(world)
    base = [(n + MILLION) / (total + size * MILLION) for n in world]
    arrays = lambda df, name: df.withColumn(name, F.array(*(F.col(f"n{i}") for i in each))).drop(*(f"n{i}" for i in each))
    tables = arrays(hosts, "by_host").join(arrays(suffixes, "by_suffix").withColumnRenamed("suffix", "s_"), F.col("suffix").eqNullSafe(F.col("s_"))).drop("s_")
    tables = tables.withColumnsRenamed({"host": "h_", "suffix": "s_"})
    own_host = F.col("host").eqNullSafe(F.col("h_")) & F.col("suffix").eqNullSafe(F.col("s_"))
    n_hosts, n_rows = hosts.agg(F.count("*"), F.sum("rows")).first()
    if n_hosts <= broadcast_hosts:
        joined = evidence.join(F.broadcast(tables.drop("rows")), own_host)
    else:
        hot = F.broadcast(tables.where(F.col("rows") * HOT_PART >= n_rows).drop("rows"))
        others = evidence.join(hot.select("h_", "s_"), own_host, "left_anti")
        joined = evidence.join(hot, own_host).unionByName(others.join(tables.drop("rows"), own_host))
    # how often text of a language comes with a declaration: at most ``size`` squared numbers
    told = evidence.where(F.col("declared").isin(names)).groupBy("declared").agg(*sums).collect()
    confusion = {r["declared"]: [r[f"n{i}"] or 0 for i in each] for r in told}
    given = [sum(c[i] for c in confusion.values()) for i in each]
    likely = {d: [((confusion[d][i] / MILLION if d in confusion else 0) + DECLARED_WEIGHT * ((0.8 if d == names[i] else 0.2 / max(size - 1, 1)))) / (given[i] / MILLION + DECLARED_WEIGHT) for i in each] for d in names}
    numbers = lambda values: F.array(*(F.lit(float(v)) for v in values))
    declared = numbers([1.0] * size)
    for d in names:
        declared = F.when(F.col("declared") == d, numbers(likely[d])).otherwise(declared)
    rows = joined.withColumn("told", declared)
    rest = lambda name, i: (F.col(name)[i] - F.col("p")[i]) / float(MILLION)  # noqa: E731 - without the row itself
    total_of = lambda name: sum((rest(name, i) for i in each), F.lit(0.0))
    suffix_prior = [(rest("by_suffix", i) + SUFFIX_WEIGHT * base[i]) / (total_of("by_suffix") + SUFFIX_WEIGHT) for i in each]
    rows = rows.withColumn("prior", F.array(*suffix_prior))
    host_prior = [(rest("by_host", i) + HOST_WEIGHT * F.col("prior")[i]) / (total_of("by_host") + HOST_WEIGHT) for i in each]
    # the text posterior holds an even prior, so it multiplies as a likelihood
    weights = F.array(*(F.col("p")[i].cast("double") * host_prior[i] * size * F.col("told")[i] for i in each), F.col("p")[size].cast("double"))
    rows = rows.withColumn("w", weights)
    best = F.array_max(F.zip_with("w", F.array(*map(F.lit, [*names, "und"])), lambda w, n: F.struct(w.alias("w"), n.alias("n"))))
    rows = rows.withColumn("best", best).withColumn("all", F.aggregate("w", F.lit(0.0), lambda s, w: s + w))
    p = F.round(F.col("best")["w"] / F.col("all"), 6)
    return rows.select(*back, F.col("best")["n"].alias("lang"), p.alias("p"), ((F.col("best")["n"] != "und") & (p >= accept)).alias("kept"))


def identify_documents(docs: DataFrame, model: dict, *, carry: list[str], text: str = "text", host: str = "source", **options) -> DataFrame:
    """Documents without address or markup: text, and the source as host."""
    none = F.lit(None).cast("string")
    rows = docs.select(_carried(carry), F.col(host).alias("host"), none.alias("suffix"), none.alias("declared"), F.col(text).alias("text"))
    return fuse(settle(text_evidence(rows, model)), model["names"], carry=carry, **options)


def identify_pages(pages: DataFrame, model: dict, *, carry: list[str], url: str = "url", html: str = "html", **options) -> DataFrame:
    """Web pages: text, declared markup language, address suffix and host."""
    host = host_of(F.col(url))
    rows = pages.select(_carried(carry), host.alias("host"), F.element_at(F.split(host, r"\."), -1).alias("suffix"), declared_in(F.col(html)).alias("declared"), F.col(html).alias("text"))
    return fuse(settle(text_evidence(rows, model, is_html=True)), model["names"], carry=carry, **options)
