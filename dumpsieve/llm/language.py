"""Language of texts by interpolated Kneser-Ney models of characters, one per language."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpsieve.llm.shared import CHUNK_CHARS, remainder, stored, text_chunks

ORDER = 4
_SPACE = 32
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """A 16-bit letter for every code point: lower-cased letters, a space for all else."""
    table = np.full(sys.maxunicode + 1, _SPACE, np.uint16)
    for code in range(sys.maxunicode + 1):
        letter = chr(code)
        if letter.isalpha():
            low = letter.lower()
            table[code] = (ord(low) if len(low) == 1 else code) % 65521 or 1
    return table


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text and packed characters of every letter and word end, each with the three before it.

    Characters before the word count as spaces, so nothing reaches over words or texts.
    """
    texts = [t or "" for t in texts]
    lengths = np.array([len(t) + 1 for t in texts])
    joined = "\n".join(texts) + "\n"
    codes = _folding()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), lengths)
    keep = codes != _SPACE
    keep[1:] |= codes[:-1] != _SPACE
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    packed, clear = codes, np.zeros(len(codes), bool)
    for back in range(1, ORDER):
        before = np.full(len(codes), _SPACE, np.uint64)
        before[back:] = codes[:-back]
        clear = clear | (before == _SPACE)
        before[clear] = _SPACE
        packed = packed | (before << np.uint64(16 * back))
    return owner, packed


def _pieces(part: pa.RecordBatch) -> Iterator[tuple[list[int], list[str | None]]]:
    """Texts of a batch; a text longer than a chunk comes in pieces, all of them."""
    short, texts = [], []
    for row, text in enumerate(part.column("text").to_pylist()):
        if text is not None and len(text) > CHUNK_CHARS:
            for at in range(0, len(text), CHUNK_CHARS):
                yield [row], [text[at : at + CHUNK_CHARS]]
        else:
            short.append(row)
            texts.append(text)
    if short:
        yield short, texts


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_chunks(batches):
        langs = part.column("lang").to_pylist()
        names = sorted(set(langs))
        number = np.array([names.index(x) for x in langs])
        for rows, texts in _pieces(part):
            owner, grams = grams_of(texts)
            spoken = number[np.array(rows)][owner]
            for k, name in enumerate(names):
                found, counts = np.unique(grams[spoken == k], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(counts)],
                    names=["lang", "gram", "n"],
                )


_BASE = -np.log(65536.0)  # log probability of a character below all orders


def _model(counts: DataFrame) -> DataFrame:
    """Interpolated Kneser-Ney per language, as terms (lang, kind, key, value) of all n-grams of ``counts``.

    With kind 2n, what having seen an n-gram adds to the log probability that is left without it; with
    2n + 1, the log weight of the order below for a context of n - 1 characters. The log probability of a
    character is the base and the terms of its n-grams and contexts, so terms can be looked up one by one.
    """
    types = {ORDER: counts.select("lang", "gram", F.col("n").cast("double").alias("number"))}

    def shorter(n: int) -> Column:
        return F.col("gram").bitwiseAND(F.lit((1 << 16 * n) - 1).cast("long"))

    for n in range(ORDER - 1, 0, -1):  # how many different characters a shorter n-gram follows
        grown = types[n + 1].groupBy("lang", shorter(n).alias("gram")).agg(F.count("*").cast("double").alias("number"))
        types[n] = stored(grown, "grams")
    terms: list[DataFrame] = []
    below = None
    for n in range(1, ORDER + 1):
        once, twice = F.count_if(F.col("number") == 1), F.count_if(F.col("number") == 2)
        discount = F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5)
        discounts = types[n].groupBy("lang").agg(discount.alias("discount"))  # one row per language
        context = F.shiftrightunsigned("gram", 16) if n > 1 else F.lit(0).cast("long")
        contexts = types[n].groupBy("lang", context.alias("context")).agg(
            F.sum("number").alias("total"), F.count("*").alias("kinds")
        ).join(F.broadcast(discounts), "lang")
        weight = F.greatest(F.col("discount") * F.col("kinds") / F.greatest("total", F.lit(1e-12)), F.lit(1e-12))
        contexts = stored(contexts.select("lang", "context", "total", "discount", F.log(weight).alias("weight")), "contexts")
        level = types[n].withColumn("context", context)
        if n > 1:
            level = level.join(contexts, ["lang", "context"]).withColumn("rest", shorter(n - 1)).join(below, ["lang", "rest"])
        else:
            level = level.join(F.broadcast(contexts), ["lang", "context"]).withColumn("low", F.lit(float(_BASE)))
        without = F.col("weight") + F.col("low")
        log = F.log((F.col("number") - F.col("discount")) / F.col("total") + F.exp(without))
        level = stored(level.select("lang", "gram", log.alias("low"), (log - without).alias("value")), "level")
        below = level.select("lang", F.col("gram").alias("rest"), "low")
        terms.append(level.select("lang", F.lit(2 * n).alias("kind"), F.col("gram").alias("key"), "value"))
        terms.append(contexts.select("lang", F.lit(2 * n + 1).alias("kind"), F.col("context").alias("key"), F.col("weight").alias("value")))
    return stored(functools.reduce(DataFrame.union, terms), "model")


def fit_languages(docs: DataFrame, train: Column) -> DataFrame:
    """The models (see :func:`_model`) of all non-null values of lang among the rows of ``docs`` (text, lang) where ``train`` holds."""
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = rows.mapInArrow(_counter, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return _model(stored(counts, "grams"))


def _slice(model: DataFrame, names: list[str], block: int, blocks: int) -> list[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """One block of the terms: for each language, sorted keys and values by kind."""
    found = model.filter(F.pmod(F.xxhash64("kind", "key"), F.lit(blocks).cast("long")) == block)
    number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")).cast("int") - 1
    found = found.select(number.alias("lang"), "kind", "key", "value").toArrow()
    langs, kinds, keys, values = (found.column(c).to_numpy() for c in ("lang", "kind", "key", "value"))
    order = np.lexsort((keys.view(np.uint64), kinds, langs))
    langs, kinds, keys, values = langs[order], kinds[order], keys[order].view(np.uint64), values[order]
    out: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in names]
    cuts = np.flatnonzero(np.diff(langs * 16 + kinds, prepend=-1, append=-1))
    for begin, end in zip(cuts[:-1], cuts[1:]):
        out[langs[begin]][int(kinds[begin])] = keys[begin:end], values[begin:end]
    return out


def _asked(grams: np.ndarray, kind: int) -> np.ndarray:
    own = grams & np.uint64((1 << 16 * (kind // 2)) - 1)
    return own >> np.uint64(16) if kind % 2 else own


def _scorer(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            sums, n = np.zeros((part.num_rows, len(tables.value))), np.zeros(part.num_rows, np.int64)
            for rows, texts in _pieces(part):
                owner, grams = grams_of(texts)
                at = np.array(rows)[owner]
                distinct, inverse = np.unique(grams, return_inverse=True)
                n += np.bincount(at, minlength=part.num_rows)
                logs = np.zeros((len(tables.value), len(distinct)))
                for kind in range(2, 2 * ORDER + 2):
                    asked, where = np.unique(_asked(distinct, kind), return_inverse=True)
                    for k, table in enumerate(tables.value):
                        if kind in table and len(asked):
                            keys, values = table[kind]
                            place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                            logs[k] += np.where(keys[place] == asked, values[place], 0.0)[where]
                for k in range(len(logs)):
                    sums[:, k] += np.bincount(at, weights=logs[k][inverse], minlength=part.num_rows)
            offsets = np.arange(part.num_rows + 1, dtype=np.int32) * sums.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), part.column("lang"), pa.array(n), lists],
                names=["row", "doc_id", "lang", "n", "sums"],
            )

    return run


def _guesser(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n = part.column("n").to_numpy().astype(np.float64)
            sums = pc.list_flatten(part.column("sums")).to_numpy().reshape(part.num_rows, len(names)) + _BASE * n[:, None]
            some = (n > 0) & bool(names)
            entropy = -sums / np.maximum(n, 1)[:, None]
            best = entropy.argmin(1) if names else np.zeros(part.num_rows, int)
            rows = np.arange(part.num_rows)
            least = entropy[rows, best] if names else np.zeros(part.num_rows)
            # Odds against the other languages for a text of a few words, whatever the length.
            odds = np.exp(-(entropy - least[:, None]) * np.minimum(n, 30)[:, None]).sum(1) if names else np.ones(part.num_rows)
            guess = [names[b] if s else UNKNOWN for b, s in zip(best, some)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang"), pa.array(guess, pa.string()),
                 pa.array(np.where(some, 1 / odds, 0.0)), pa.array(least, mask=~some)],
                names=["doc_id", "lang", "lang_pred", "score", "cross_entropy"],
            )

    return run


def _scores(rows: DataFrame, model: DataFrame, block_terms: int) -> DataFrame:
    """``rows`` (doc_id, text, lang) with lang_pred, score and cross_entropy.

    The terms are broadcast in blocks of about ``block_terms``, one pass over the texts for each; the
    sums of a text over all blocks are added up.
    """
    names = sorted(r["lang"] for r in model.select("lang").distinct().collect())
    blocks = max(1, -(-model.count() // block_terms))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    if blocks > 1:
        rows = stored(rows, "numbered")  # every pass must see the same numbers
    schema = "row long, doc_id long, lang string, n long, sums array<double>"
    passes: list[DataFrame] = []
    for block in range(blocks):
        tables = rows.sparkSession.sparkContext.broadcast(_slice(model, names, block, blocks))
        found = rows.mapInArrow(_scorer(tables), schema)
        if blocks > 1:
            found = stored(found, "sums").withColumn("block", F.lit(block))
            tables.unpersist()
        passes.append(found)
    out = passes[0]
    if blocks > 1:
        parts = F.array_sort(F.collect_list(F.struct("block", "sums"))).getField("sums")
        added = F.aggregate(parts, F.array_repeat(F.lit(0.0), len(names)), lambda x, y: F.zip_with(x, y, lambda p, q: p + q))
        out = functools.reduce(DataFrame.union, passes).groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("lang").alias("lang"), F.first("n").alias("n"), added.alias("sums")
        )
    return out.mapInArrow(_guesser(names), "doc_id long, lang string, lang_pred string, score double, cross_entropy double")


def identify_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.995,
    block_terms: int = 1 << 21,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out; texts and non-null languages of
    the others train the models. lang_pred is the language of the lowest cross-entropy per
    character, ``und`` (score 0) for null texts, texts without a letter, or where no language
    was learnt. A text is ``rejected`` if its cross-entropy is 1.25 times what ``quantile`` of
    the training texts of that language stay below. Rows with a null id never train; repeated
    rows give repeated results; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    train = F.coalesce(remainder("doc_id", 4) != 2, F.lit(False))
    guessed = stored(_scores(rows, fit_languages(rows, train), block_terms), "languages")
    limits = guessed.filter(train & (F.col("lang") == F.col("lang_pred"))).groupBy("lang_pred").agg(
        (F.percentile_approx("cross_entropy", quantile, 1000) * 1.25).alias("limit")
    )
    out = guessed.join(F.broadcast(limits), "lang_pred", "left")  # one row per language
    return out.select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy",
        F.coalesce(F.col("cross_entropy") > F.col("limit"), F.lit(True)).alias("rejected"),
    )
