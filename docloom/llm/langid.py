"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton. A
text is parsed greedily into the longest phrases that occur in the sample; the
number of phrases, times the bits that a position in a sample costs, over the
number of characters estimates the cross entropy (Ziv and Merhav, "A measure of
relative entropy between individual sequences", 1993). The language that needs
fewest normalised phrases wins. A position costs the same in every language,
that in the longest sample, so a short sample is no advantage.

Every character of the samples has a code of its own. The automata are tables,
built once in each Python worker from the samples, the only thing that is sent:
dense ones for the commonest characters, and one hash table of the transitions
by all others, so large scripts cost memory by the sample, not by the alphabet.

Texts are cut into lanes of ``LANE`` characters that all step through the tables
together in numpy, each as if a phrase began with it. Then every lane's last
phrase goes on into the next lane until a phrase of both parses begins at one
place; from there on they are equal, and what the lane counted before is
replaced. So the counts are those of one parse of the whole text.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.arrow import add_columns
from docloom.plans.tables import materialize

#: Bounds of the training sample: languages, rows per language, characters per language.
MAX_LANGUAGES, SAMPLE_ROWS, SAMPLE_CHARS = 64, 64, 16_000
#: Parts of a language's distinct texts among which its sample is chosen first, so that no task ranks them all.
PARTS = 64
#: States of an automaton, at most two a character, that the tables can hold.
MAX_STATES = 0x7FFE
#: Codes of the dense tables; characters with higher codes step through the hash table.
LANE, WIDTH = 256, 64
#: Characters times languages parsed at a time: bounds a worker's memory (one text may exceed it).
BATCH_CHARS = 4_000_000
NONE = "und"
LETTER = re.compile(r"[^\W\d_]")


def training_sample(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, str]:
    """Sample texts by language, at most ``SAMPLE_CHARS`` characters each, in lower case.

    The sample is the ``SAMPLE_ROWS`` distinct texts of least hash in each
    language, whole ones while there is room, else equal parts of each; a text
    that has many copies counts once. The sample is the only thing that the
    driver holds, and its size is fixed by the three bounds above. The least
    hashes are found in two levels, first in ``PARTS`` parts of each language.
    Rows without a language or text, and languages without a letter, teach
    nothing. Raises if there are more than ``MAX_LANGUAGES`` labels.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    if rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    hashes = rows.select("lang", "h").distinct().withColumn("part", F.pmod(F.hash("h"), F.lit(PARTS)))
    rank = F.row_number().over(Window.partitionBy("lang", "part").orderBy("h"))
    least = hashes.withColumn("r", rank).where(F.col("r") <= SAMPLE_ROWS)
    # At most PARTS * SAMPLE_ROWS hashes a language are left.
    least = least.groupBy("lang").agg(F.slice(F.sort_array(F.collect_set("h")), 1, SAMPLE_ROWS).alias("hs"))
    least = materialize(least.select("lang", F.posexplode("hs").alias("r", "h")), "sample")
    pieces = rows.join(F.broadcast(least), ["lang", "h"]).select("lang", "r", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    out = {}
    grouped = pieces.groupBy("lang").agg(F.sort_array(F.collect_set(F.struct("r", "text"))).alias("ts"))
    for row in grouped.orderBy("lang").collect():
        texts = [fold(t["text"]) for t in row["ts"]]
        # Equal shares, a line break each; what short texts leave over goes to the others.
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        room, cut = SAMPLE_CHARS - len(texts) + 1, {}
        for n, i in enumerate(order):
            cut[i] = texts[i][: max(0, room // (len(order) - n))]
            room -= len(cut[i])
        out[row["lang"]] = "\n".join(cut[i] for i in range(len(texts)))[:SAMPLE_CHARS]
    return {k: v for k, v in out.items() if LETTER.search(v)}


def fold(text: str) -> str:
    """What parsing sees: lower case; marks and digits are taken as they are."""
    return text.lower()


class SuffixAutomaton:
    """The automaton of one sample, as a table of next states by state and code."""

    def __init__(self, codes: list[int]) -> None:
        nxt, link, length = [{}], [-1], [0]
        last = 0
        for c in codes:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next = nxt

    def table(self) -> np.ndarray:
        """Entries ``state | 0x8000`` end a phrase: the code begins the next one.

        The root is only the state before the first code, which ends nothing.
        The last state stands for a code that the sample doesn't have, a phrase
        that nothing can lengthen.
        """
        n = len(self.next)
        begin = np.full(WIDTH, n, np.uint16)
        for c, s in self.next[0].items():
            if c < WIDTH:
                begin[c] = s
        out = np.tile(begin | np.uint16(0x8000), (n + 1, 1))
        out[0] = begin
        for i, row in enumerate(self.next):
            for c, s in row.items():
                if c < WIDTH:
                    out[i, c] = s
        # Code 0 pads lanes and changes nothing; code 1 is any character that no sample has.
        out[:, 0] = np.arange(n + 1, dtype=np.uint16)
        return out.reshape(-1)

    def others(self) -> list[tuple[int, int, int]]:
        """(state, code, next state) of the codes that the table has no column for."""
        return [(i, c, s) for i, row in enumerate(self.next) for c, s in row.items() if c >= WIDTH]


class Transitions:
    """Next states by (language, state, code): an open hash table, searched for whole arrays."""

    def __init__(self, keys: np.ndarray, states: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.states = np.zeros(1 << self.bits, np.int64)
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            put = self.keys[at] == keys
            self.states[at[put]] = states[put]
            keys, states, at = keys[~put], states[~put], self._next(at[~put])

    @staticmethod
    def key(language: np.ndarray, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        # States take 15 bits, codes at most 21.
        return (language << 36) | (state << 21) | code

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            seen = self.keys[at]
            hit = seen == keys[left]
            out[left[hit]] = self.states[at[hit]]
            go = ~hit & (seen >= 0)
            left, at = left[go], self._next(at[go])
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@functools.lru_cache(maxsize=2)
def _model(samples: tuple[tuple[str, str], ...]) -> tuple:
    folded = [fold(s) for _, s in samples]
    common = [c for c, _ in sorted(Counter("".join(folded)).items(), key=lambda x: (-x[1], x[0]))]
    lookup = np.ones(0x110000, np.int32)
    lookup[[ord(c) for c in common]] = np.arange(2, len(common) + 2)
    tables, others = [], [np.zeros((0, 4), np.int64)]
    for i, s in enumerate(folded):
        automaton = SuffixAutomaton(lookup[_points(s)].tolist())
        if len(automaton.next) > MAX_STATES:
            raise ValueError(f"the sample of {samples[i][0]!r} is too long: {len(s)} characters")
        tables.append(automaton.table())
        others += [np.array([(i, *x) for x in found], np.int64)] if (found := automaton.others()) else []
    offsets = np.cumsum([0, *(len(t) for t in tables[:-1])]).astype(np.int64)
    lang, state, code, to = np.concatenate(others).T
    rare = Transitions(Transitions.key(lang, state, code), to)
    unknown = np.array([len(t) // WIDTH - 1 for t in tables], np.int64)
    bits = math.log2(max([2, *map(len, folded)]))
    return lookup, np.concatenate(tables), offsets, bits, [k for k, _ in samples], rare, unknown


def _step(model: tuple, lang: np.ndarray, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether the code begins a phrase) of flat arrays."""
    _, table, offsets, _, _, rare, unknown = model
    common = code < WIDTH
    got = table.take(offsets[lang] + (state << 6) + np.where(common, code, 1))
    begun, then = got > 0x7FFF, (got & 0x7FFF).astype(np.int64)
    at = np.flatnonzero(~common)
    if len(at):
        # By a code without a column: from this state, or else from the root, where it begins a phrase.
        la, old, c = lang[at], state[at], code[at].astype(np.int64)
        to = rare.find(rare.key(la, old, c))
        miss = np.flatnonzero(to < 0)
        to[miss] = rare.find(rare.key(la[miss], np.zeros(len(miss), np.int64), c[miss]))
        then[at] = np.where(to < 0, unknown[la], to)
        begun[at] = False
        begun[at[miss]] = old[miss] > 0
    return then, begun


def _carry_on(model: tuple, grid: np.ndarray, starts: np.ndarray, lang: np.ndarray, lane: np.ndarray, state: np.ndarray) -> tuple:
    """Parse on from ``state`` into whole lanes, up to where a phrase begins that the lane's own parse begins, too.

    Returns what to add to the lane's own count, the last state, and whether
    there was such a place (then the lane's own last state is right).
    """
    add, last, met = np.zeros(len(lane), np.int64), state.copy(), np.zeros(len(lane), bool)
    left = np.arange(len(lane))
    for k in range(LANE):
        if not len(left):
            break
        la, ln = lang[left], lane[left]
        then, begun = _step(model, la, last[left], grid[k, ln])
        own = starts[k, la, ln]
        hit = begun & own
        last[left] = then
        go = ~hit
        met[left[hit]] = True
        left = left[go]
        add[left] += begun[go].astype(np.int64) - own[go]
    return add, last, met


def phrase_counts(texts: list[str], samples: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases by text and language, and characters by text."""
    model = _model(samples)
    lookup, table, offsets = model[:3]
    codes = [lookup[_points(fold(t))] for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    lanes = -(-sizes // LANE)
    total, langs = int(lanes.sum()), len(offsets)
    if not total:
        return np.zeros((len(texts), langs)), sizes
    grid = np.zeros(total * LANE, np.int32)
    at = np.concatenate([[0], np.cumsum(lanes)])
    for c, i in zip(codes, at, strict=False):
        grid[i * LANE : i * LANE + len(c)] = c
    grid = np.ascontiguousarray(grid.reshape(total, LANE).T)
    some = (grid >= WIDTH).any(axis=1)
    state = np.zeros((langs, total), np.int64)
    starts = np.zeros((LANE, langs, total), bool)
    every = np.repeat(np.arange(langs), total)
    base = offsets[:, None]
    for k, (step, more) in enumerate(zip(grid, some, strict=True)):
        if more:
            then, begun = _step(model, every, state.reshape(-1), np.tile(step, langs))
            state, starts[k] = then.reshape(langs, total), begun.reshape(langs, total)
        else:
            got = table.take(base + (state << 6) + step)
            starts[k] = got > 0x7FFF
            state = (got & 0x7FFF).astype(np.int64)
    starts[0] = True
    count = starts.sum(axis=0, dtype=np.int64)
    first = np.zeros(total + 1, bool)
    first[at[:-1][lanes > 0]] = first[total] = True
    # All lanes that another comes before, each from that one's last state.
    lang, lane = (x.reshape(-1) for x in np.meshgrid(np.arange(langs), np.flatnonzero(~first[:total]), indexing="ij"))
    add = np.zeros((langs, total), np.int64)
    met = np.ones((langs, total), bool)
    last = state.copy()
    add[lang, lane], last[lang, lane], met[lang, lane] = _carry_on(model, grid, starts, lang, lane, state[lang, lane - 1])
    # Where a lane never met its own parse, its last state is another one: the lanes after it are parsed anew, one by
    # one, until one of them meets its own; from there the first pass holds, up to the text's next lane that didn't meet.
    whose = np.searchsorted(at, np.arange(total), side="right")
    unmet = [np.flatnonzero(~m) for m in met]
    pairs = [(la, ln) for la, found in enumerate(unmet) for ln in found[np.unique(whose[found], return_index=True)[1]]]
    lang, lane = np.array(pairs, np.int64).reshape(-1, 2).T
    while len(lane):
        on = ~first[lane + 1]
        lang, lane = lang[on], lane[on] + 1
        add[lang, lane], last[lang, lane], done = _carry_on(model, grid, starts, lang, lane, last[lang, lane - 1])
        follow = lane.copy()
        for i in np.flatnonzero(done):
            found = unmet[lang[i]]
            k = np.searchsorted(found, lane[i], side="right")
            follow[i] = found[k] if k < len(found) and whose[found[k]] == whose[lane[i]] else -1
        lang, lane = lang[follow >= 0], follow[follow >= 0]
    sums = np.add.reduceat(np.concatenate([count + add, np.zeros((langs, 1), np.int64)], axis=1), at[:-1], axis=1)
    sums[:, lanes == 0] = 0
    return sums.T, sizes


def judge(texts: list[str | None], samples: tuple[tuple[str, str], ...]) -> list[tuple[str, float, float]]:
    """(language, score, bits a character) of each text."""
    out: list = [(NONE, 0.0, 0.0)] * len(texts)
    if not samples:
        return out
    bits, names = _model(samples)[3:5]
    room = max(LANE, BATCH_CHARS // len(samples))
    todo = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)]
    while todo:
        n, chars = 0, 0
        while n < len(todo) and (not n or chars + len(texts[todo[n]]) <= room):
            chars += len(texts[todo[n]])
            n += 1
        now, todo = todo[:n], todo[n:]
        counts, sizes = phrase_counts([texts[i] for i in now], samples)
        rates = counts * bits / np.maximum(sizes, 1)[:, None]
        best = counts.argmin(axis=1)
        for k, i in enumerate(now):
            b = int(best[k])
            rest = np.delete(counts[k], b)
            score = 1.0 if not len(rest) else 1 - int(counts[k, b]) / int(rest.min())
            out[i] = (names[b], min(1.0, max(0.0, score)), float(rates[k, b]))
    return out


def identify_languages(docs: DataFrame, samples: dict[str, str], text: str = "text") -> DataFrame:
    """Add lang_pred, score and lang_bits to every row; nothing is shuffled.

    ``lang_pred`` is a key of ``samples``, or ``und`` (score 0) where the text
    is null or has no letter, and everywhere if there are no samples. The score
    is one less the ratio of the best normalised phrase count to the second
    best (1 if only one language was learned; ties go to the first language in
    order of code points, score 0). ``lang_bits`` is the winner's estimate in bits a
    character. Columns of these names are replaced.
    """
    learned = tuple(sorted(samples.items()))
    added = {
        "lang_pred": (T.StringType(), pa.string()),
        "score": (T.DoubleType(), pa.float64()),
        "lang_bits": (T.DoubleType(), pa.float64()),
    }
    return add_columns(docs, [text], added, lambda texts: list(zip(*judge(texts, learned), strict=True)) or [[], [], []])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame) -> dict[str, str]:
    """Samples from the labelled rows whose id isn't held out."""
    return training_sample(docs.where(~held_out()))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from four fifths of the labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = identify_languages(docs.select("doc_id", "text"), learn(docs))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
