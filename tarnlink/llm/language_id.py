"""Language identification by Bayesian fusion of text, declared language, address and smoothed host priors."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import materialize, salted_lookup, shield, unshield, with_content_key

#: Labelled rows of each language the text model is fitted on at most, and the hashed byte trigrams of the model.
SAMPLE, GRAMS = 1000, 1 << 13
SLICES = 1024
#: How much a trigram counts as evidence beside its neighbours, which share two of its bytes.
WEIGHT = 0.5
#: Nats a trigram by which text of no language has to beat the best language.
MARGIN = 1.5
#: The share of a language's trigrams that training has not seen, spread over all: the same however much it has read.
UNSEEN = 0.05
#: How often a declared language and an address hint are right, and rows' worth of the smoothing at each level.
DECLARED, HINTED, SMOOTH = 0.95, 0.8, 20.0
#: Country suffixes that name a language, and labels that stand for nobody before a country.
SUFFIX = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en"}
SECOND = ("co", "com", "org", "net", "ac", "gov", "edu", "or", "ne", "go", "gob", "asso", "gouv")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SIGNS = bytes(c for c in range(128) if not chr(c).isalpha())
_WORDS = _LOWER.translate(bytes.maketrans(_SIGNS, b" " * len(_SIGNS)))
_MARKUP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def grams(text: str | None) -> np.ndarray:
    """Hashes of the byte trigrams of the words of a text, padded by single spaces."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)
    words = data.split()
    if not words:
        return np.empty(0, np.uint32)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x01000193) + b[1:-1]) * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(19)


@dataclass
class TextModel:
    """Log probability of each trigram under each language; the last row is text of no language: uniform, less MARGIN,
    so that names, numbers and codes within a text of few words do not outweigh them."""

    languages: list[str]
    table: np.ndarray

    def means(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its number of trigrams, and its mean log probability by language."""
        n, out = np.zeros(len(texts)), np.zeros((len(texts), len(self.table)))
        for i, text in enumerate(texts):
            found = grams(text)
            n[i] = len(found)
            if len(found):
                out[i] = self.table @ np.bincount(found, minlength=GRAMS) / len(found)
        return n, out


def code_of(declared: Column) -> Column:
    """The language of a code such as EN or en-US, as en; null unless it has two or three letters before the region."""
    found = F.lower(F.regexp_extract(F.trim(declared), r"^([A-Za-z]{2,3})(?:[-_][A-Za-z0-9]+)*$", 1))
    return F.when(found != "", found)


def fold_of(text: str = "text") -> Column:
    """0 or 1 by the text, so that exact copies are in one fold."""
    return F.pmod(F.xxhash64(F.lit(22), text), F.lit(2)).cast("int")


def train(docs: DataFrame, sample: int = SAMPLE) -> list[TextModel]:
    """Two models, fitted on the rows (text, lang) of fold 1 and of fold 0, so that model i has seen no text of fold i.

    At most sample texts a language, taken by a hash of the text, whole; copies count once. Languages are the codes of lang
    (code_of), whatever their case or region.
    """
    named = docs.select("text", code_of(F.col("lang")).alias("lang")).where("lang is not null and length(text) > 0").withColumn("t", F.xxhash64(F.lit(21), "text"))
    # the smallest hashes of each of SLICES slices, so that no task gets a whole language; the driver gets 4 * sample + SLICES a language at most
    keys = named.select("lang", "t").distinct().withColumn("slice", F.pmod("t", F.lit(SLICES)))
    first = F.row_number().over(Window.partitionBy("lang", "slice").orderBy("t"))
    taken: dict[str, list[int]] = {}
    for r in keys.withColumn("at", first).where(F.col("at") <= -(-4 * sample // SLICES)).select("lang", "t").collect():
        taken.setdefault(r.lang, []).append(r.t)
    keys = docs.sparkSession.createDataFrame([(x, t) for x, ts in taken.items() for t in sorted(ts)[:sample]], "lang string, t long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table: dict[tuple, np.ndarray] = {}
            for text, *key in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own = np.bincount(grams(text), minlength=GRAMS)
                table[tuple(key)] = table[tuple(key)] + own if tuple(key) in table else own
            for (lang, fold), own in table.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([fold] * len(at), pa.int32()), pa.array(at), pa.array(own[at])], ["lang", "fold", "gram", "n"])

    rows = named.join(F.broadcast(keys), ["lang", "t"]).dropDuplicates(["lang", "t"])
    rows = rows.select("text", "lang", fold_of().alias("fold")).mapInArrow(run, "lang string, fold int, gram long, n long")
    found = rows.groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in found})
    at = {x: i for i, x in enumerate(languages)}
    models = []
    for fold in (0, 1):
        table = np.zeros((len(languages) + 1, GRAMS))
        for r in found:
            if r.fold != fold:
                table[at[r.lang], r.gram] += r.n
        table = table / np.maximum(1, table.sum(1, keepdims=True)) * (1 - UNSEEN) + UNSEEN / GRAMS
        table[-1] = 1 / GRAMS
        table = np.log(table)
        table[-1] -= MARGIN
        models.append(TextModel(languages, table))
    return models


def page_text(html: str | None) -> str:
    return _MARKUP.sub(" ", html or "")


def declared_of(html: str = "html") -> Column:
    """The language of the html element's lang attribute, or null."""
    return code_of(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([^\"'\s>]+)", 1))


def host_of(url: str = "url") -> Column:
    found = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.coalesce(found, F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host; three if the last is a country and the one before stands for nobody, as in co.uk."""
    last, before = F.substring_index(host, ".", -1), F.substring_index(F.substring_index(host, ".", -2), ".", 1)
    return F.when((F.length(last) == 2) & before.isin(*SECOND), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def hint_of(languages: Sequence[str], url: str = "url") -> Column:
    """The language an address names: a first path segment that is one of languages, a region allowed, else a country
    suffix, else null."""
    path = code_of(F.regexp_extract(url, r"^[^?#]*?//[^/?#]+/([A-Za-z]{2,3}(?:[-_][A-Za-z]{2})?)(?:[/?#]|$)", 1))
    top = F.substring_index(host_of(url), ".", -1)
    suffix = F.element_at(F.create_map(*(F.lit(x) for kv in SUFFIX.items() for x in kv)), top)
    return F.coalesce(F.when(path.isin(*languages), path), suffix)


def identify(rows: DataFrame, models: Sequence[TextModel], markup: bool = False, carry: Sequence[str] = ("id",)) -> DataFrame:
    """(carry, language, probability, accepted) of rows (carry, text, declared, hint, host, domain, fold).

    The posterior is text likelihood (each trigram for WEIGHT, by the model of the row's fold) x P(declared | language) x
    P(hint | language) x P(language | host). Host priors are grouped counts of what the text alone says, smoothed by
    those of the domain, which are smoothed by those of all rows. accepted is false for a text of no language: without
    letters, likelier under the uniform model, or whose best language has less than half of the posterior. Null and
    empty texts are not accepted, with language null and probability 0. Null evidence counts as none, a null fold as 0;
    hosts that hold many rows are dealt out; rows that repeat are judged each; an empty table gives no rows.
    """
    languages, kinds = models[0].languages, len(models[0].languages)
    size, kept = kinds + 1, len(carry)
    where = {x: i for i, x in enumerate(languages)}

    def text_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, fold = b.column(kept).to_pylist(), b.column(kept + 5).to_numpy()
            texts = [page_text(x) for x in texts] if markup else texts
            n, means = np.zeros(len(texts)), np.zeros((len(texts), size))
            for k, model in enumerate(models):
                own = np.flatnonzero(fold == k)
                n[own], means[own] = model.means([texts[i] for i in own])
            best = np.where(n > 0, means.argmax(1), kinds)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(n) + 1, size, dtype=np.int32)), pa.array(means.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(kept)), *(b.column(kept + i) for i in range(1, 5)), pa.array(n), lists, pa.array(best.astype(np.int32))],
                [*carry, "declared", "hint", "host", "domain", "n", "means", "best"],
            )

    fill = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = rows.select(*carry, "text", fill("declared"), fill("hint"), fill("host"), fill("domain"), F.coalesce("fold", F.lit(0)).alias("fold"))
    given = [f for f in rows.schema.fields if f.name in carry]
    kind = lambda **kw: StructType([*given, *(StructField(k, v) for k, v in kw.items())])
    text, real = StringType(), DoubleType()
    found = rows.mapInArrow(text_run, kind(declared=text, hint=text, host=text, domain=text, n=real, means=ArrayType(real), best=IntegerType()))
    found = materialize(found, "language-text")
    votes = [F.sum((F.col("best") == i).cast("double")).alias(f"v{i}") for i in range(kinds)]
    hosts = materialize(found.groupBy("domain", "host").agg(F.count(F.lit(1)).alias("n_rows"), *votes), "language-hosts")
    sums = [F.sum(f"v{i}").alias(f"d{i}") for i in range(kinds)]
    total = hosts.agg(F.sum("n_rows"), *sums).first()
    everywhere = [((total[i + 1] or 0) + 1) / (sum(x or 0 for x in total[1:]) + max(1, kinds)) for i in range(kinds)]
    domains = hosts.groupBy("domain").agg(F.count(F.lit(1)).alias("n_hosts"), *sums)
    plus = lambda names: sum((F.col(x) for x in names), F.lit(0.0))
    upper = [(F.col(f"d{i}") + SMOOTH * everywhere[i]) / (plus([f"d{j}" for j in range(kinds)]) + SMOOTH) for i in range(kinds)]
    domains = domains.select("domain", "n_hosts", *(x.alias(f"p{i}") for i, x in enumerate(upper)))
    lower = [(F.col(f"v{i}") + SMOOTH * F.col(f"p{i}")) / (plus([f"v{j}" for j in range(kinds)]) + SMOOTH) for i in range(kinds)]
    hosts = salted_lookup(hosts, domains, ["domain"], "n_hosts", ["host"])
    hosts = hosts.select("domain", "host", "n_rows", F.array(*lower).cast("array<double>").alias("prior"))
    joined = salted_lookup(found.drop("best"), hosts, ["domain", "host"], "n_rows", ["n", "means"])

    def fuse_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(kept + 2).to_numpy()
            score = np.array(b.column(kept + 3).to_pylist(), np.float64).reshape(-1, size) * (WEIGHT * n)[:, None]
            if kinds:
                score[:, :kinds] += np.log(np.array(b.column(kept + 4).to_pylist(), np.float64).reshape(-1, kinds) * 0.999)
            score[:, kinds] += np.log(0.001)
            for column, right in ((kept, DECLARED), (kept + 1, HINTED)):
                for i, x in enumerate(b.column(column).to_pylist()):
                    if x in where:
                        score[i, :kinds] += np.log((1 - right) / max(1, kinds - 1)) if kinds > 1 else 0
                        score[i, where[x]] += np.log(right) - (np.log((1 - right) / (kinds - 1)) if kinds > 1 else 0)
                        score[i, kinds] += np.log(1 / kinds)
            p = np.exp(score - score.max(1, keepdims=True)) if len(score) else score
            p = p / p.sum(1, keepdims=True) if len(p) else p
            best = p[:, :kinds].argmax(1) if kinds and len(p) else np.zeros(len(p), int)
            value = p[np.arange(len(p)), best] if kinds else np.zeros(len(p))
            text = (n > 0) & (kinds > 0)
            names = pa.array([languages[k] if ok else None for k, ok in zip(best, text, strict=True)], pa.string())
            cols = [names, pa.array(np.where(text, value, 0.0)), pa.array(text & (value >= 0.5))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(kept)), *cols], [*carry, "language", "probability", "accepted"])

    fields = joined.select(*carry, "declared", "hint", "n", "means", "prior")
    return fields.mapInArrow(fuse_run, kind(language=text, probability=real, accepted=BooleanType()))


def _evidence(docs: DataFrame, *carry: Column | str) -> DataFrame:
    """What documents (doc_id, text, lang, source) say: lang is declared, source is the host, there is no address."""
    none = F.lit(None).cast("string")
    declared = code_of(F.col("lang"))
    return docs.select(*carry, "text", declared.alias("declared"), none.alias("hint"), F.col("source").alias("host"), F.lit("").alias("domain"), fold_of().alias("fold"))


def identify_documents(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """identify() of documents (doc_id, text, lang, source), each text by the model that has not seen its label. Other columns
    are ignored; a null doc_id is kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    return identify(_evidence(docs, "doc_id"), train(docs, sample), carry=("doc_id",))


def identify_pages(pages: DataFrame, models: Sequence[TextModel]) -> DataFrame:
    """identify() of pages (page_id, url, html)."""
    host = host_of()
    evidence = (declared_of().alias("declared"), hint_of(models[0].languages).alias("hint"), host.alias("host"), domain_of(host).alias("domain"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").alias("text"), *evidence, fold_of("html").alias("fold"))
    return identify(rows, models, markup=True, carry=("page_id",))


def accept_documents(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that identify_documents() accepts, unchanged, whatever other columns they have.

    Rows are named by their content, so those of null doc_id are judged like others, and rows that share a doc_id each by
    its own text.
    """
    own = ["doc_id", "text", "lang", "source"]
    rows = with_content_key(shield(docs, own), own)
    kept = identify(_evidence(rows, "k1", "k2"), train(docs.select("text", "lang"), sample), carry=("k1", "k2"))
    kept = materialize(kept.where("accepted").select("k1", "k2").distinct(), "language-kept")
    return unshield(rows.join(kept, ["k1", "k2"], "left_semi"), docs, own)
