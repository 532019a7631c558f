"""Collocations by broadcast double-array tries.

Texts are cut into pieces and words; a phrase is two or three words in a row inside one piece, counted per language. Four passes
read the texts:

1. words and their counts;
2. pairs as two 64-bit word keys, summed: pairs that reach ``min_count`` are the candidates of level two. A sum by key is never less than
   the count of a phrase, so no phrase is lost (and a pair that reaches it has two words that reach it);
3. triples whose two pairs are candidates, found by walking the tries of level two, summed in the same way;
4. all candidates, counted by tries: the language and the words of a phrase are the symbols of a double-array trie, numpy moves the
   states of all text positions one level on at a time, and a bincount of accepting states is summed over the tasks.

Tries are built by tasks from shards of candidates and broadcast. ``max_trie_phrases`` bounds what is broadcast: were there
more candidates, those of fewest occurrences would keep the sums of passes 2 and 3, which are exact where no two words share a key;
phrases of words that do share one are always in a trie. The result does not depend on the bound.

A phrase is as strong as its weakest cut: floor(1000000 * a * a / (l * r)) with exact decimals. A phrase that lies inside a longer candidate with
at least half its count goes. The first ``k`` of each language stay, ties to the larger count, then to the smaller phrase.

Nulls: a null text is an empty one, a null language is ``und``; ids are not read. Repeated rows count each time. Texts without words and
empty tables give no rows. Other columns are ignored.
"""

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.groups import top_k
from .common import parts_for, slices, written

MAX_TRIE_PHRASES = 2_000_000
PHRASES_PER_TRIE = 300_000
SLICE = 5_000_000  # bytes of text handled at a time
_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\v\f\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_DONE = 1 << 30  # base of a state without children
_MODEL = "shard int, state int, lang string, w1 string, w2 string, w3 string, blob binary"
_MODEL_ARROW = pa.schema([("shard", pa.int32()), ("state", pa.int32()), ("lang", pa.string()), ("w1", pa.string()), ("w2", pa.string()),
                          ("w3", pa.string()), ("blob", pa.binary())])


class Tokens:
    """The words of a batch: the distinct ones, their numbers in text order, the piece and the language of each place."""

    def __init__(self, batch):
        text = batch.column("text").cast(pa.large_binary())
        docs = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[docs[0]:docs[-1]]
        docs = docs - docs[0]
        kind = _KIND[data]
        inside = kind == 0
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        first, last = docs[:-1][docs[:-1] < len(data)], docs[1:][docs[1:] > 0] - 1
        start[first], end[last] = inside[first], inside[last]
        start, end = np.flatnonzero(start), np.flatnonzero(end)
        n = len(start)
        offsets = np.concatenate([[0], np.cumsum(end + 1 - start)]).astype(np.int32)
        each = np.diff(np.searchsorted(start, docs))
        words = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])).dictionary_encode()
        lang = batch.column("lang").dictionary_encode()
        self.words, self.ids = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
        self.named, self.langs = lang.dictionary, np.repeat(lang.indices.to_numpy(zero_copy_only=False), each)
        # both grow along the texts, so two places have the same sum only inside one piece of one text
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[start] + np.repeat(np.arange(len(each)), each)
        self._keys = None

    def keys(self, at, which):
        """64-bit keys of (language, word) of the words at some places, for the languages of the places ``which``."""
        if self._keys is None:
            from pandas.util import hash_array
            self._keys = [hash_array(x.to_numpy(zero_copy_only=False).astype(object), hash_key=k, categorize=False) for x, k in (
                (self.words, "words of phrases"), (self.named, "language of words"[:16]))]
        word, lang = self._keys
        return pa.array((word[self.ids[at]] + lang[self.langs[which]]).view(np.int64))

    def runs(self, length):
        """Places where so many words in a row lie in one piece."""
        n = max(0, len(self.ids) - length + 1)
        return self.piece[:n] == self.piece[length - 1:length - 1 + n]


def _word_rows(batches):
    for whole in batches:
        for batch in slices(whole, chars=SLICE):
            t = Tokens(batch)
            pair, at, n = np.unique(t.langs.astype(np.int64) * len(t.words) + t.ids, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [t.named.take(pa.array(t.langs[at])), t.words.take(pa.array(t.ids[at])), t.keys(at, at), pa.array(n)], names=["lang", "word", "key", "n"])


def _summed(t, at, names):
    """One row for each distinct run of words that starts at one of the places, with its count."""
    size = max(1, len(t.words))
    code = t.langs[at].astype(np.int64)
    for j in range(len(names)):
        if len(code) and int(code.max()) >= (1 << 62) // size:
            code = np.unique(code, return_inverse=True)[1]
        code = code * size + t.ids[at + j]
    _, where, n = np.unique(code, return_index=True, return_counts=True)
    at = at[where]
    return pa.RecordBatch.from_arrays([*[t.keys(at + j, at) for j in range(len(names))], pa.array(n)], names=[*names, "n"])


def _pair_rows(batches):
    for whole in batches:
        for batch in slices(whole, chars=SLICE):
            t = Tokens(batch)
            yield _summed(t, np.flatnonzero(t.runs(2)), ["k1", "k2"])


class Trie:
    """Double array over symbols: words from 0, then languages. A state is a place; check holds the state it is reached from."""

    def __init__(self, words, langs, base, check, accept):
        self.words, self.langs, self.base, self.check, self.accept = words, langs, base, check, accept

    @staticmethod
    def build(lang, *columns):
        """From equally long lists: languages and the words of each phrase, None where a phrase is shorter. Returns trie and states."""
        n = len(lang)
        words = pa.concat_arrays([pa.array(c, pa.string()) for c in columns]).dictionary_encode()
        codes = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).reshape(len(columns), n)
        named = pa.array(lang, pa.string()).dictionary_encode()
        vocabulary = len(words.dictionary)
        symbols = np.vstack([named.indices.to_numpy(zero_copy_only=False) + vocabulary, codes]).astype(np.int64)
        slots = _Slots()
        state = np.zeros(n, np.int64)
        for level in symbols:
            there = np.flatnonzero(level >= 0)
            if not len(there):
                break
            edge, back = np.unique(state[there] << 32 | level[there], return_inverse=True)
            state[there] = slots.place(edge >> 32, edge & 0xFFFFFFFF)[back]
        accept = np.zeros(slots.end, bool)
        accept[state] = True
        trie = Trie(words.dictionary.to_pylist(), named.dictionary.to_pylist(), slots.base[:slots.end], slots.check[:slots.end], accept)
        return trie, state

    def step(self, state, symbol):
        """(which of the states move on, where to)."""
        to = self.base[state] + symbol
        ok = (to >= 0) & (to < len(self.check))
        ok[ok] = self.check[to[ok]] == state[ok]
        return ok, to[ok]

    def starts(self, named):
        """The state after each language; -1 for one that the trie lacks."""
        code = pc.index_in(named, value_set=pa.array(self.langs, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        out = np.full(len(code), -1, np.int64)
        known = np.flatnonzero(code >= 0)
        ok, to = self.step(np.zeros(len(known), np.int64), code[known] + len(self.words))
        out[known[ok]] = to
        return out

    def walk(self, t, levels=3):
        """Yields (places, states) after one, two and three words, for all places of the texts at once."""
        code = pc.index_in(t.words, value_set=pa.array(self.words, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        symbol = np.append(code[t.ids], np.full(levels, -1))
        piece = np.append(t.piece, np.full(levels, -1))
        state = self.starts(t.named)[t.langs]
        place = np.flatnonzero(state >= 0)
        state = state[place]
        for level in range(levels):
            known = (symbol[place + level] >= 0) & (piece[place + level] == piece[place])
            place, state = place[known], state[known]
            ok, state = self.step(state, symbol[place + level])
            place = place[ok]
            yield place, state

    def dumps(self):
        return zlib.compress(pickle.dumps((self.words, self.langs, self.base, self.check, self.accept)), 1)

    @staticmethod
    def loads(data):
        return Trie(*pickle.loads(zlib.decompress(data)))


class _Slots:
    """Places of a double array, given out level by level; nodes of many children first, single children fill what is left."""

    WIDE = 256  # nodes of more children go behind all others, where nothing is in their way
    TRIES = 64

    def __init__(self):
        self.base, self.check = np.full(1024, _DONE, np.int32), np.full(1024, -1, np.int32)
        self.check[0] = 0  # the root's own place
        self.end, self.used = 1, 1
        self.random = np.random.default_rng(1)

    def _reach(self, size):
        self._room(size)
        self.end = max(self.end, size)

    def _room(self, size):
        if size > len(self.base):
            more = max(size, len(self.base) + (len(self.base) >> 2)) - len(self.base)
            self.base = np.append(self.base, np.full(more, _DONE, np.int32))
            self.check = np.append(self.check, np.full(more, -1, np.int32))

    def place(self, parent, symbol):
        """Places for edges sorted by parent, then symbol."""
        self.used += len(parent)
        self._room(2 * self.used)  # half empty, so that random places fit
        out = np.empty(len(parent), np.int64)
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        size = np.diff(np.append(first, len(parent)))
        for i in np.argsort(-size, kind="stable"):
            if size[i] == 1:
                break
            part = slice(first[i], first[i] + size[i])
            base, above = self._base(symbol[part]), parent[first[i]]
            out[part] = symbol[part] + base
            self._reach(int(out[part][-1]) + 1)
            self.base[above], self.check[out[part]] = base, above
        single = first[size == 1]
        if len(single):
            free = np.flatnonzero(self.check[:self.end] < 0)[:len(single)]
            free = np.append(free, np.arange(self.end, self.end + len(single) - len(free)))
            self._reach(int(free[-1]) + 1)
            out[single] = free
            self.check[free] = parent[single]
            self.base[parent[single]] = free - symbol[single]
        return out

    def _base(self, symbols):
        """A base under which all the symbols fall on free places: some random ones are tried, behind the end one always fits."""
        rel = symbols - symbols[0]
        if len(rel) <= self.WIDE:
            limit = len(self.check) - int(rel[-1])
            for _ in range(8 if limit > 1 else 0):
                fits = self.random.integers(1, limit, self.TRIES)
                for j in range(0, len(rel), 4):
                    fits = fits[(self.check[fits[:, None] + rel[None, j:j + 4]] < 0).all(axis=1)]
                if len(fits):
                    return int(fits[0]) - int(symbols[0])
        return self.end - int(symbols[0])


def _model(shard, lang, w1, w2, w3):
    trie, state = Trie.build(lang, w1, w2, w3)
    n = len(lang)
    return pa.Table.from_arrays([
        pa.array([shard] * (n + 1), pa.int32()), pa.array([-1, *state.tolist()], pa.int32()), pa.array([None, *lang], pa.string()),
        pa.array([None, *w1], pa.string()), pa.array([None, *w2], pa.string()), pa.array([None, *w3], pa.string()),
        pa.array([trie.dumps(), *[None] * n], pa.binary())], schema=_MODEL_ARROW)


def tries(phrases, n_phrases, per_trie=PHRASES_PER_TRIE):
    """(written table of states, broadcast tries): each shard of phrases becomes a trie in a task of its own."""
    n = parts_for(n_phrases, per_trie)

    def build(table):
        column = {c: table.column(c).to_pylist() for c in table.column_names}
        return _model(column["shard"][0], column["lang"], column["w1"], column["w2"], column["w3"])

    sharded = phrases.select(F.pmod(F.xxhash64("lang", "w1", "w2"), F.lit(n)).cast("int").alias("shard"), "lang", "w1", "w2", "w3")
    model = written(sharded.groupBy("shard").applyInArrow(build, _MODEL), "phrase-tries")
    blobs = [(r["shard"], bytes(r["blob"])) for r in model.filter("state = -1").select("shard", "blob").collect()]
    return model.filter("state >= 0").drop("blob"), phrases.sparkSession.sparkContext.broadcast(blobs)


_LOADED = {}


def _loaded(sent):
    """The tries of a broadcast, unpacked once in each Python worker."""
    key = id(sent.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = sent.value, [(shard, Trie.loads(blob)) for shard, blob in sent.value]
    return _LOADED[key][1]


def _triples(docs, sent, complete):
    """Sums of runs of three words; with tries of all pairs only of those whose two pairs are candidates."""
    def run(batches):
        found = _loaded(sent) if complete else []
        for whole in batches:
            for batch in slices(whole, chars=SLICE):
                t = Tokens(batch)
                inside = t.runs(3)
                if complete:
                    pair = np.zeros(len(t.ids) + 1, bool)
                    for _, trie in found:
                        for level, (place, state) in enumerate(trie.walk(t, 2), 1):
                            if level == 2:
                                pair[place[trie.accept[state]]] = True
                    inside &= pair[:len(inside)] & pair[1:len(inside) + 1]
                yield _summed(t, np.flatnonzero(inside), ["k1", "k2", "k3"])

    return docs.mapInArrow(run, "k1 bigint, k2 bigint, k3 bigint, n bigint")


def _counts(docs, sent):
    """shard, state, a: occurrences of all phrases of the tries. Tasks are two for each core, since a task ships a row for each phrase it has
    met, and what it sums by itself is not shipped."""
    docs = docs.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        found = _loaded(sent)
        total = [np.zeros(len(t.check), np.int64) for _, t in found]
        for whole in batches:
            for batch in slices(whole, chars=SLICE):
                t = Tokens(batch)
                for (_, trie), sums in zip(found, total):
                    for level, (_, state) in enumerate(trie.walk(t), 1):
                        if level > 1:
                            sums += np.bincount(state[trie.accept[state]], minlength=len(sums))
        for (shard, _), sums in zip(found, total):
            state = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(state), shard, np.int32)), pa.array(state.astype(np.int32)), pa.array(sums[state])],
                                             names=["shard", "state", "n"])

    return docs.mapInArrow(run, "shard int, state int, n bigint").groupBy("shard", "state").agg(F.sum("n").alias("a"))


def _named(sums, words, keys, min_count):
    """Candidates: key sums of min_count or more with the words behind the keys; ``alone`` if no other word has one of them."""
    out = sums.groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count).withColumn("alone", F.lit(True)).withColumn("lang", F.lit(None).cast("string"))
    for i, key in enumerate(keys, 1):
        w = words.select(F.col("key").alias(key), F.col("word").alias(f"w{i}"), F.col("lang").alias("_lang"), F.col("alone").alias("_alone"))
        out = out.join(w, key).filter(F.col("lang").isNull() | (F.col("lang") == F.col("_lang")))
        out = out.withColumn("lang", F.col("_lang")).withColumn("alone", F.col("alone") & F.col("_alone")).drop("_lang", "_alone")
    if len(keys) == 2:
        out = out.withColumn("w3", F.lit(None).cast("string"))
    return out.select("lang", "w1", "w2", "w3", "n", "alone")


def _head(phrases, limit):
    """The phrases for the tries and how many they are: those of shared keys and, from the most frequent, as many as the bound lets in."""
    bands = {r["band"]: r["c"] for r in phrases.groupBy(
        F.when(F.col("alone"), F.floor(F.log2(F.col("n").cast("double"))).cast("int")).otherwise(99).alias("band")).agg(F.count("*").alias("c")).collect()}
    taken, least = 0, 100
    for band in sorted(bands, reverse=True):
        if band != 99 and taken + bands[band] > limit:
            break
        taken, least = taken + bands[band], band
    inside = ~F.col("alone") | (F.floor(F.log2(F.col("n").cast("double"))) >= least)
    return phrases.filter(inside), phrases.filter(~inside), taken, taken == sum(bands.values())


def phrase_counts(docs, min_count=10, max_trie_phrases=MAX_TRIE_PHRASES, per_trie=PHRASES_PER_TRIE, lang_col="lang", text_col="text"):
    """(words, phrases): lang, word, n of all words; lang, w1, w2, w3, a of all phrases of two or three words with a >= min_count."""
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = docs.mapInArrow(_word_rows, "lang string, word string, key bigint, n bigint").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
    words = written(words.withColumn("alone", F.count("*").over(Window.partitionBy("key")) == 1), "phrase-words")
    frequent = words.filter(F.col("n") >= min_count)
    pairs = written(_named(docs.mapInArrow(_pair_rows, "k1 bigint, k2 bigint, n bigint"), frequent, ["k1", "k2"], min_count), "phrase-pairs")
    head, _, n_head, complete = _head(pairs, max_trie_phrases)
    _, sent = tries(head, n_head, per_trie)
    triples = _named(_triples(docs, sent, complete), frequent, ["k1", "k2", "k3"], min_count)
    phrases = written(pairs.unionByName(triples), "phrase-candidates")
    sent.unpersist()
    head, tail, n_head, _ = _head(phrases, max_trie_phrases)
    model, sent = tries(head, n_head, per_trie)
    counted = _counts(docs, sent).join(model, ["shard", "state"]).select("lang", "w1", "w2", "w3", "a")
    kept = tail.select("lang", "w1", "w2", "w3", F.col("n").alias("a"))
    return words.select("lang", "word", "n"), written(counted.unionByName(kept).filter(F.col("a") >= min_count), "phrase-counts")


def _exact(c):
    return F.col(c).cast("decimal(15,0)")


def collocations(docs, k=2000, min_count=10, cover=50, max_trie_phrases=MAX_TRIE_PHRASES, per_trie=PHRASES_PER_TRIE, lang_col="lang", text_col="text"):
    """lang, rank, phrase, a, l, r, n, score: the k strongest phrases of each language."""
    words, phrases = phrase_counts(docs, min_count, max_trie_phrases, per_trie, lang_col, text_col)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    pairs, triples = phrases.filter("w3 IS NULL"), phrases.filter("w3 IS NOT NULL")

    def word(column, count):
        return words.select("lang", F.col("word").alias(column), F.col("n").alias(count))

    def pair(first, second, count):
        return pairs.select("lang", F.col("w1").alias(first), F.col("w2").alias(second), F.col("a").alias(count))

    two = pairs.join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
    inside = F.explode(F.array(F.struct(F.col("w1"), F.col("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))))
    longer = triples.select("lang", "a", inside.alias("p")).groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer"))
    two = two.join(longer, ["lang", "w1", "w2"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    two = two.select("lang", "a", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.array(F.struct("l", "r")).alias("cuts"))
    three = (triples.join(word("w1", "l1"), ["lang", "w1"]).join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"])
             .join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(word("w3", "r2"), ["lang", "w3"]))
    three = three.select("lang", "a", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
                         F.array(F.struct(F.col("l1").alias("l"), F.col("r1").alias("r")), F.struct(F.col("l2").alias("l"), F.col("r2").alias("r"))).alias("cuts"))
    million = F.lit(1_000_000).cast("decimal(7,0)")
    cut = two.unionByName(three).select("*", F.posexplode("cuts").alias("cut", "lr")).select("lang", "a", "phrase", "cut", "lr.l", "lr.r")
    cut = cut.withColumn("above", million * (_exact("a") * _exact("a"))).withColumn("below", _exact("l") * _exact("r"))
    weak = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("above div below").alias("score"), "cut", "l", "r")).alias("m"))
    scored = weak.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    best = top_k(scored, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], k, ["phrase"])
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
