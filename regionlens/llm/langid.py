"""Language ID with interpolated Kneser-Ney character models.

A word (a run of letters, lower-cased) is scored as a sequence of characters with three start marks
and an end mark. Spark counts the character 4-grams of all training texts per language, derives the
continuation counts of the lower orders, discounts and back-off weights by grouped aggregations, and
these tables stay in Spark, whole and however many 4-grams there are. The documents are dealt into blocks;
the distinct 4-grams of the corpus are joined with the tables, order by order, to their bits under every
language, and each block gets the bits of its own 4-grams beside its texts. The predicted language has the lowest cross-entropy per character; a text is rejected if that value is above the limit that
the training texts of its language and length calibrate, from their entropies under their own and
under the next best language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, ship, table, written

ORDER = 4
BLOCK = 1 << 24
"""Bytes of text in a block, about: a task holds the distinct 4-grams of one block."""
FILES = 1 << 16
"""Files told apart in dealing blocks; of more, those of one hash share their blocks."""
MOST_PARTS = 100_000
"""Blocks are dealt into so many partitions at most, each block into one."""
LANGUAGES = 256
"""Languages scored at once; with more of them the texts pass several times."""
SIZES = 40
"""Size classes: powers of two of the characters, the last one open."""
QUANTILE, MARGIN, SPREAD = 0.999, 0.5, 12.5
"""A text is rejected above the QUANTILE of its calibration class plus MARGIN bits a character and SPREAD
over the root of its characters (about five standard errors of the mean bits of so many characters), or
half-way to what texts cost under a foreign language's model, if that is more."""
_LETTERS = re.compile(r"[^\W\d_]+")
_START, _END = "\x02", "\x03"
_WORDS = 50_000
_CACHE = 250_000
_CHARS = 1_000_000
_GRAMS = 1_000_000
UND = "und"


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def letters_of(word: str) -> str:
    """The word without the few word characters that are no letters (such as superscripts)."""
    return word if word.isascii() or word.isalpha() else "".join(c for c in word if c.isalpha())


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the padded words, the places of the predicted characters among them, and each
    word's number of these."""
    padded = "".join(_START * (ORDER - 1) + w + _END for w in words)
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    at = np.arange(len(points))
    at = at[at - np.repeat(np.cumsum(size) - size, size) >= ORDER - 1]
    return points, at, size - ORDER + 1


def _grams_at(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ORDER code points up to each place, as rows."""
    return points[at[:, None] + np.arange(1 - ORDER, 1)]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of (block, language, 4-gram) in each batch; the language may be null."""
    for batch in batches:
        words: dict[tuple, Counter] = {}
        for block, text, lang in zip(batch["block"], batch["text"], batch["lang"], strict=True):
            words.setdefault((block, lang), Counter()).update(words_of(text))
        for (block, lang), counted in words.items():
            some = [(x, n) for w, n in counted.items() if (x := letters_of(w))]
            for i in range(0, len(some), _WORDS):
                types, n = zip(*some[i : i + _WORDS], strict=True)
                points, at, size = _points(list(types))
                _, first, same = np.unique(_window_hashes(points, ORDER)[at - ORDER + 1], return_index=True, return_inverse=True)
                total = np.bincount(same.ravel(), np.repeat(np.array(n, float), size))
                text = _grams_at(points, at[first]).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                grams = [text[j : j + ORDER] for j in range(0, len(text), ORDER)]
                yield pd.DataFrame({"block": block, "lang": pd.Series([lang] * len(grams), dtype=object), "gram": grams, "n": total.astype(np.int64)})


def block_counts(rows: DataFrame) -> DataFrame:
    """(block, lang, gram, n) over all ``rows`` (block, text, lang), several rows of the same key among them."""
    ship(rows.sparkSession)
    return rows.select("block", "text", "lang").mapInPandas(_counted, "block bigint, lang string, gram string, n bigint")


def gram_counts(part: DataFrame) -> DataFrame:
    """(lang, gram, n) of the block counts that have a language."""
    return part.where("lang is not null").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(grams: DataFrame) -> DataFrame:
    """(lang, order, kind, gram, value): kind ``p`` is the discounted share of a gram in its context,
    kind ``g`` the weight of the next lower order after a context."""
    level, tables, n = grams, [], grams.count()
    for order in range(ORDER, 0, -1):
        ones = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        # the usual estimate of the discount; kept inside (0, 1) where counts are few
        d = F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))))
        ones = ones.select("lang", F.coalesce(d, F.lit(0.5)).alias("d"))
        context = F.substring("gram", 1, order - 1)
        totals = level.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        totals = totals.join(F.broadcast(ones), "lang")
        tables.append(
            level.withColumn("context", context).join(totals, ["lang", "context"])
            .select("lang", F.lit(order).alias("order"), F.lit("p").alias("kind"), "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("value"))
        )
        tables.append(
            totals.select("lang", F.lit(order).alias("order"), F.lit("g").alias("kind"), F.col("context").alias("gram"), (F.col("d") * F.col("types") / F.col("total")).alias("value"))
        )
        if order > 1:
            level = written(level.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")), "level", n)
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def gram_bits(rows: DataFrame, grams: DataFrame, langs: list[str], uniform: float) -> DataFrame:
    """(gram, bits): the bits of the last character of each of the distinct ``grams`` after those before it,
    under every language, from the Kneser-Ney ``rows``. Lower orders come first, each one a join by gram,
    by context and by the gram without its first character."""
    place = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])

    def by(order: int, kind: str, key: str) -> DataFrame:
        some = rows.where((F.col("order") == order) & (F.col("kind") == kind))
        pairs = F.collect_list(F.struct(place[F.col("lang")], "value"))  # one a language
        return some.groupBy(F.col("gram").alias(key)).agg(F.map_from_entries(pairs).alias(kind))

    need = {ORDER: grams.select("gram")}
    for order in range(ORDER - 1, 0, -1):
        need[order] = need[order + 1].select(F.expr("substring(gram, 2)").alias("gram")).distinct()
    low = None
    for order in range(1, ORDER + 1):
        level = need[order].withColumn("context", F.substring("gram", 1, order - 1)).withColumn("rest", F.expr("substring(gram, 2)"))
        weights = by(order, "g", "context")
        level = level.join(by(order, "p", "gram"), "gram", "left").join(F.broadcast(weights) if order == 1 else weights, "context", "left")
        if low is None:
            level = level.withColumn("low", F.array_repeat(F.lit(uniform), len(langs)))
        else:
            level = level.join(low, "rest")
        value = lambda x, i: F.coalesce(F.try_element_at("p", i), F.lit(0.0)) + F.coalesce(F.try_element_at("g", i), F.lit(1.0)) * x
        low = level.select(F.col("gram").alias("rest"), F.transform("low", value).alias("low"))
    return low.select(F.col("rest").alias("gram"), F.transform("low", lambda x: (-F.log2(x)).cast("float")).alias("bits"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """Hash of the code points of each row."""
    h = np.full(len(rows), rows.shape[1], np.uint64)
    for i in range(rows.shape[1]):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, i].astype(np.uint64))
    return h


def _window_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points from each place on (fewer places at the end)."""
    return _row_hashes(np.lib.stride_tricks.sliding_window_view(points, n))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, order, kind, gram, value) with the gram's hash in its place."""
    for batch in batches:
        size = batch["gram"].str.len().to_numpy()
        hashes = np.zeros(len(batch), np.uint64)
        for n in set(size.tolist()) - {0}:
            at = np.flatnonzero(size == n)
            points = np.frombuffer("".join(batch["gram"].iloc[at]).encode("utf-32-le", "surrogatepass"), "<u4")
            hashes[at] = _window_hashes(points, int(n))[:: int(n)]
        yield batch[["lang", "order", "kind", "value"]].assign(hash=hashes.view(np.int64))


class Model:
    """Sorted hash arrays per language, order and kind, with the scores of words.

    ``rows``: lang (place in ``langs``), order, kind (0: shares, 1: weights of the next order), hash, value.
    """

    def __init__(self, langs: list[str], alphabet: int, rows: pd.DataFrame):
        self.langs, self.uniform, self.tables = langs, 1.0 / (alphabet + 1), {}
        for (lang, order, kind), part in rows.groupby(["lang", "order", "kind"]):
            h = part["hash"].to_numpy(np.int64).view(np.uint64)
            at = np.argsort(h)
            self.tables[langs[lang], order, "pg"[kind]] = h[at], part["value"].to_numpy(np.float32)[at]

    def _value(self, key: tuple, h: np.ndarray, missing: float) -> np.ndarray:
        if key not in self.tables:
            return np.full(len(h), missing, np.float32)
        keys, values = self.tables[key]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, values[at], np.float32(missing))

    def gram_bits(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last code point of each row after those before it, under every language."""
        hashes = {0: np.zeros(len(grams), np.uint64)}
        tails = {0: hashes[0]}  # of the points before the last one
        for n in range(1, ORDER + 1):
            hashes[n] = _row_hashes(grams[:, ORDER - n :])
            tails[n] = _row_hashes(grams[:, ORDER - 1 - n : ORDER - 1]) if n < ORDER else hashes[0]
        out = np.empty((len(grams), len(self.langs)), np.float32)
        for k, lang in enumerate(self.langs):
            p = np.full(len(grams), self.uniform)
            for order in range(1, ORDER + 1):
                p = self._value((lang, order, "p"), hashes[order], 0.0) + self._value((lang, order, "g"), tails[order - 1], 1.0) * p
            out[:, k] = -np.log2(p)
        return out


class Known:
    """The bits of a block's 4-grams under every language, in place of the whole model."""

    def __init__(self, langs: list[str], grams: list[str], bits: np.ndarray):
        points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, ORDER)
        h = _row_hashes(points)
        at = np.argsort(h)
        self.langs, self.keys, self.bits = langs, h[at], bits[at]

    def gram_bits(self, grams: np.ndarray) -> np.ndarray:
        h = _row_hashes(grams)
        at = np.searchsorted(self.keys, h)
        if len(h) and (not len(self.keys) or (self.keys[np.minimum(at, len(self.keys) - 1)] != h).any()):
            raise ValueError("a text of the block has 4-grams that were not counted: the table changed meanwhile")
        return self.bits[at]


class Scorer:
    """Sums word scores; the scores of a bounded number of 4-grams and words are kept."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.rows = np.zeros((0, len(model.langs) + 1), np.float32)
        self.keys, self.bits = np.zeros(0, np.uint64), np.zeros((0, len(model.langs)), np.float32)

    def _gram_rows(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of the characters at the given places, from the table of known 4-grams."""
        h, first, same = np.unique(_window_hashes(points, ORDER)[at - ORDER + 1], return_index=True, return_inverse=True)
        if len(self.keys) > _GRAMS:
            self.keys, self.bits = self.keys[:0], self.bits[:0]
        place = np.searchsorted(self.keys, h)
        new = np.ones(len(h), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != h[inside]
        if new.any():
            bits = self.model.gram_bits(_grams_at(points, at[first[new]]))
            keys, bits = np.concatenate([self.keys, h[new]]), np.concatenate([self.bits, bits])
            order = np.argsort(keys)
            self.keys, self.bits = keys[order], bits[order]
            place = np.searchsorted(self.keys, h)
        return self.bits[place[same.ravel()]]

    def word_bits(self, words: list[str]) -> np.ndarray:
        """For each word the bits under every language, and its characters with the end mark."""
        points, at, size = _points(words)
        out = np.empty((len(words), len(self.model.langs) + 1), np.float32)
        out[:, :-1] = np.add.reduceat(self._gram_rows(points, at), np.cumsum(size) - size, axis=0)
        out[:, -1] = size
        return out

    def sums(self, texts: list) -> np.ndarray:
        """Bits under every language and characters of each text."""
        parts, i = [np.zeros((0, len(self.model.langs) + 1))], 0
        while i < len(texts):
            j, size = i, 0  # some million characters at a time: their words are held at once
            while j < len(texts) and (j == i or size < _CHARS):
                size += len(texts[j] or "")
                j += 1
            parts.append(self._sums([words_of(t) for t in texts[i:j]]))
            i = j
        return np.concatenate(parts)

    def _sums(self, words: list[list[str]]) -> np.ndarray:
        if len(self.known) > _CACHE:
            self.known, self.rows = {}, self.rows[:0]
        new = list(set().union(*words).difference(self.known))
        fresh = [self.rows]
        for i in range(0, len(new), _WORDS):
            part = [letters_of(w) for w in new[i : i + _WORDS]]
            bits = np.zeros((len(part), self.rows.shape[1]), np.float32)
            if some := [w for w in part if w]:
                bits[[bool(w) for w in part]] = self.word_bits(some)
            fresh.append(bits)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.rows = np.concatenate(fresh)
        out = np.zeros((len(words), self.rows.shape[1]))
        for i, w in enumerate(words):
            if w:
                at = np.fromiter(map(self.known.__getitem__, w), np.int64, len(w))
                for j in range(0, len(at), 100_000):
                    out[i] += self.rows[at[j : j + 100_000]].sum(axis=0, dtype=np.float64)
        return out


_SCORED = "struct<lang: string, score: double, bits: double, next: double, chars: bigint>"


def _scores(langs: list[str], sums: np.ndarray) -> pd.DataFrame:
    """The rows of _SCORED from the sums of some texts."""
    bits, chars = sums[:, :-1], sums[:, -1]
    best, some = bits.argmin(axis=1), chars > 0
    least = bits.min(axis=1)
    second = np.partition(bits, 1, axis=1)[:, 1] if bits.shape[1] > 1 else np.full(len(sums), np.nan)
    score = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
    lang = np.array(langs, dtype=object)[best]
    return pd.DataFrame({
        "lang": np.where(some, lang, UND), "score": np.where(some, score, 0.0),
        "bits": np.where(some, least / np.maximum(chars, 1), np.nan),
        "next": np.where(some, second / np.maximum(chars, 1), np.nan), "chars": chars.astype(np.int64),
    })


def _no_scores(n: int) -> pd.DataFrame:
    return pd.DataFrame({"lang": [UND] * n, "score": 0.0, "bits": np.nan, "next": np.nan, "chars": 0})


def with_scores(docs: DataFrame, bits: DataFrame | None, langs: list[str], out: str, block: str, text_col: str = "text", parts: int = 1) -> DataFrame:
    """``docs``, dealt into ``parts`` partitions by ``block``, with a struct ``out``: lang (``und`` without letters), score (probability of the
    language among the learned ones), bits (cross-entropy a character), next (that of the second best
    language), chars. ``bits`` (block, gram, bits) has all 4-grams of the texts of each ``block``."""
    ship(docs.sparkSession)
    if bits is None:
        none = F.struct(F.lit(UND), F.lit(0.0), F.lit(float("nan")), F.lit(float("nan")), F.lit(0).cast("bigint")).cast(_SCORED)
        return docs.withColumn(out, none)

    @F.pandas_udf(_SCORED)
    def scored(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        now, grams, values, scorer = None, [], [], None
        for block, gram, bits, text in batches:
            block, parts = block.to_numpy(), []
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and block[a] != now:
                    now, grams, values, scorer = block[a], [], [], None
                n = int(gram.iloc[a:b].notna().sum())  # 4-grams come before texts
                if n:
                    grams += gram.iloc[a : a + n].tolist()
                    values.append(np.stack(bits.iloc[a : a + n].to_list()).astype(np.float32))
                    parts.append(_no_scores(n))
                if a + n < b:
                    if scorer is None:
                        scorer = Scorer(Known(langs, grams, np.concatenate([np.zeros((0, len(langs)), np.float32), *values])))
                        grams, values = [], []
                    parts.append(_scores(langs, scorer.sums(text.iloc[a + n : b].tolist())))
            yield pd.concat(parts, ignore_index=True) if parts else _no_scores(0)

    names = [free_name([*docs.columns, out], x) for x in ("_gram", "_bits")]
    both = bits.toDF(block, *names).unionByName(docs, allowMissingColumns=True)
    dealt = both.repartition(parts, block).sortWithinPartitions(block, F.col(names[0]).isNull())
    dealt = dealt.withColumn(out, scored.asNondeterministic()(block, names[0], names[1], text_col))
    return dealt.where(F.col(names[0]).isNull()).select(*docs.columns, out)


def better(one: Column, other: Column) -> Column:
    """The scores of a text under two sets of languages (structs of _SCORED) as those under both; of equal
    entropies the first one's language."""
    size = F.greatest(one["chars"].cast("double"), F.lit(1.0))
    first = one["bits"] <= other["bits"]
    least = F.least(one["bits"], other["bits"])
    share = lambda x: F.try_divide(F.pow(F.lit(2.0), F.greatest((least - x["bits"]) * size, F.lit(-1000.0))), x["score"])
    none = lambda x: F.nanvl(x, F.lit(float("inf")))  # noqa: E731  no second language
    second = F.least(F.when(first, other["bits"]).otherwise(one["bits"]), none(one["next"]), none(other["next"]))
    both = F.struct(
        F.when(first, one["lang"]).otherwise(other["lang"]).alias("lang"), F.try_divide(F.lit(1.0), share(one) + share(other)).alias("score"),
        least.alias("bits"), second.alias("next"), one["chars"].alias("chars"),
    )
    return F.when(one["chars"] > 0, both).otherwise(one)


def with_block(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """``docs`` with ``out``, the hash of the row's file (with very many files, of some of them) and of a piece of
    about BLOCK bytes in it: the same at every reading; and the number of blocks. A file has as many pieces
    as its texts' bytes need, so large and small files give blocks alike. Rows that come from no file are
    dealt by hash alone."""
    file, same, pieces = (free_name([*docs.columns, out], x) for x in ("_file", "_same", "_pieces"))
    named = docs.withColumn(file, F.pmod(F.xxhash64(F.input_file_name()), F.lit(FILES)))
    size = F.sum(F.octet_length(text_col).cast("bigint"))
    sizes = named.groupBy(F.col(file).alias(same)).agg(F.greatest(F.ceil(F.coalesce(size, F.lit(0)) / BLOCK), F.lit(1)).cast("bigint").alias(pieces))
    sizes = written(sizes, "file_sizes", FILES)  # at most FILES rows of two numbers
    blocks = sizes.agg(F.sum(pieces)).first()[0] or 1
    named = named.join(F.broadcast(sizes), F.col(file) == F.col(same))
    piece = F.pmod(F.xxhash64(id_col, text_col), F.col(pieces))
    return named.withColumn(out, F.xxhash64(file, piece)).drop(file, same, pieces), blocks


def train_rows(docs: DataFrame, id_col: str = "doc_id"):
    """True for the documents that may be learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))


def learn(part: DataFrame) -> tuple[list[str], float, DataFrame | None]:
    """The languages, the uniform share of a character and the written Kneser-Ney rows of the block counts
    ``part``; without any letter to learn from there is no language. Only the languages' names are collected."""
    grams = written(gram_counts(part), "grams", part.count())
    langs = sorted(r[0] for r in grams.select("lang").distinct().collect())
    if not langs:
        return [], 1.0, None
    rows = written(kneser_ney(grams), "kneser_ney", 2 * ORDER * grams.count())
    alphabet = rows.where("`order` = 1 and kind = 'p'").select("gram").distinct().count()
    return langs, 1.0 / (alphabet + 1), rows


def fit(train: DataFrame) -> Model | None:
    """The model of all rows of ``train`` (text, lang) in the memory of this process, for small tables and
    comparisons (``identify`` does not need it); rows with a null in either teach nothing, and without any
    letter to learn from there is none.
    """
    known = train.where("text is not null and lang is not null").withColumn("block", F.lit(0).cast("bigint"))
    langs, uniform, rows = learn(block_counts(known))
    if not langs:
        return None
    place = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    rows = rows.select(place[F.col("lang")].alias("lang"), "order", (F.col("kind") == "g").cast("int").alias("kind"), "gram", "value")
    hashed = rows.mapInPandas(_hashed, "lang int, order int, kind int, value float, hash bigint")
    return Model(langs, round(1 / uniform) - 1, hashed.toPandas())


def limits(scored: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(lang, size, limit) from scored training rows (lang, bits, next, chars): the quantile of the
    cross-entropy among texts of the same language and at least the same size (powers of two), plus
    the margins or half the way to the median under the next best language, whichever is more. Shorter
    texts get wider limits, never narrower ones."""
    part = scored.where("chars > 0").groupBy("lang", _size(F.col("chars")).alias("size")).agg(
        F.percentile_approx("bits", quantile, 10_000).alias("q"), F.count("*").alias("n")
    )
    whole = scored.where("chars > 0").groupBy("lang").agg(
        F.percentile_approx("bits", quantile, 10_000).alias("all"), F.percentile_approx(F.nanvl("next", F.lit(None)), 0.5, 10_000).alias("foreign")
    )
    # a class with too few texts for its quantile takes at least that of the whole language
    every = whole.withColumn("size", F.explode(F.sequence(F.lit(0), F.lit(SIZES))))
    part = every.join(part, ["lang", "size"], "left").withColumn(
        "q", F.when(F.col("n") < 1 / (1 - quantile), F.greatest("q", "all")).otherwise(F.col("q"))
    )
    longer = Window.partitionBy("lang").orderBy(F.desc("size"))  # SIZES + 1 rows
    shorter = Window.partitionBy("lang").orderBy("size")
    # sizes beyond the longest training text take the limit of that
    part = part.withColumn("q", F.max("q").over(longer)).withColumn("q", F.last("q", ignorenulls=True).over(shorter))
    return part.select("lang", "size", F.greatest(F.col("q") + margin + SPREAD / F.sqrt(F.pow(F.lit(2.0), "size")), (F.col("q") + F.col("foreign")) / 2).alias("limit"))


def _size(chars: Column) -> Column:
    return F.least(F.floor(F.log2(F.greatest(chars, F.lit(1)))), F.lit(SIZES)).cast("int")


def identify(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct ``out``: lang, score, bits, next, chars, held_out,
    rejected.

    Learns from all rows with a text and a language whose crc32(id) mod 4 is not 2, and predicts from
    the text alone; every text is scored once, and the scored rows are written. Rejected are texts
    without letters (and null ones) and texts whose cross-entropy exceeds the limit of their language
    and size. A null id is neither held out nor learned from; without any training row everything is
    ``und`` and rejected. Equal entropies take the first language in order; there may be any number of
    languages (LANGUAGES at a time). Texts of any length count whole. Rows and other columns stay.
    """
    keep = docs.columns if keep is None else keep
    train = train_rows(docs, id_col)
    names = [free_name([*docs.columns, *keep, out], x) for x in ("_lang", "_size", "_limit", "_teaches", "_block", "_text", "_more")]
    dealt, blocks = with_block(docs, names[4], id_col, text_col)
    teaches = F.when(train, F.col(lang_col)).alias("lang")
    texts = dealt.where(F.col(text_col).isNotNull()).select(F.col(names[4]).alias("block"), F.col(text_col).alias("text"), teaches)
    part = written(block_counts(texts), "block_grams")
    langs, uniform, rows = learn(part)
    needed = written(part.select("block", "gram").distinct(), "needed", part.count()) if langs else None
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    # only what is kept crosses the shuffle beside the text
    some = dealt.select(
        *keep, names[4], F.col(text_col).alias(names[5]), held.alias(names[0]), (train & F.col(lang_col).isNotNull()).alias(names[3])
    )
    if text_col in keep:
        some, text = some.drop(names[5]), text_col
    else:
        text = names[5]
    scored = some
    for i in range(0, max(len(langs), 1), LANGUAGES):
        bits, now = None, langs[i : i + LANGUAGES]
        if langs:
            mine = rows.where(F.col("lang").isin(now)) if len(now) < len(langs) else rows
            bits = needed.join(gram_bits(mine, needed.select("gram").distinct(), now, uniform), "gram").select("block", "gram", "bits")
        scored = with_scores(scored, bits, now, names[6] if i else out, names[4], text, min(blocks, MOST_PARTS))
        if i:
            scored = scored.withColumn(out, better(F.col(out), F.col(names[6]))).drop(names[6])
    scored = scored.select(*keep, F.col(out).withField("held_out", F.col(names[0])).alias(out), names[3])
    scored = written(scored, "scored")
    taught = scored.where(F.col(names[3])).select(F.col(out)["lang"].alias("lang"), *[F.col(out)[c].alias(c) for c in ("bits", "next", "chars")])
    limit = written(limits(taught), "limits", (SIZES + 1) * len(langs))
    limit = F.broadcast(limit.toDF(*names[:3]))  # SIZES + 1 rows a language
    size = _size(F.col(out)["chars"])
    joined = scored.join(limit, (F.col(out)["lang"] == F.col(names[0])) & (size == F.col(names[1])), "left")
    rejected = (F.col(out)["chars"] == 0) | F.coalesce(F.col(out)["bits"] > F.col(names[2]), F.lit(False))
    return joined.select(*[F.col(c) for c in keep], F.col(out).withField("rejected", rejected).alias(out))


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects. A verdict depends on the text alone: the rejected
    rows' ids and text hashes are joined back, so that no text is carried or written beside the scores."""
    mark, x = free_name(docs.columns, "_hash"), free_name(docs.columns, "_language")
    named = docs.withColumn(mark, F.xxhash64(text_col))
    verdicts = identify(named, x, id_col, text_col, keep=[id_col, mark])
    gone = written(verdicts.where(F.col(f"{x}.rejected")).select(F.col(id_col).alias("_id"), F.col(mark).alias("_text")).distinct(), "rejected")
    kept = named.join(gone, named[id_col].eqNullSafe(gone["_id"]) & (named[mark] == gone["_text"]), "left_anti")
    return kept.select(*docs.columns)


def op8_language(spark, sf_dir: str) -> DataFrame:
    """Predicted language, score and rejection of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    x = identify(docs, "x", keep=["doc_id"]).select("doc_id", "x.*")
    return x.select("doc_id", "held_out", F.col("lang").alias("lang_pred"), "score", F.col("bits").alias("bits_per_char"), "rejected")
