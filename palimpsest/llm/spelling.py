"""Spelling variants: words one edit apart, found with a bit-sliced position index over the vocabulary.

1. Words of all texts are counted: per batch in the task, then by one aggregation.
2. Words one edit apart share their first or their last half. Every word goes to bins by (length class,
   side, half): as one of that length, which asks and is indexed, and as one letter longer, which is
   indexed only. The shorter word of a pair thus always meets the longer one. A bin takes many halves,
   and one with more words than `cells` is dealt to a grid of cells, index words by row, askers by column,
   so that no task's share grows with a common half.
3. In a cell, for every (position, letter) a bitset says which words have that letter there. For all askers
   at once the recurrence walks their letters and keeps, 64 words to a machine word,
       zero:     words equal so far,
       replaced: words equal but for one letter so far,
       inserted: words equal so far but for one extra letter, read one position further on.
   At the end `replaced` and `inserted`, cut by length, are the words at distance one.
4. Near words are counted and the most frequent one taken by one aggregation; roots follow forms by
   doubling, through tables written to the shared folder: a step multiplies n by the ratio at least, so
   that a chain is logarithmic in the largest n.

Edge cases: a null text has no words; a null doc_id counts as an empty one where words are hashed by it; rows
that share a doc_id count one by one; ties for a form go to the least word in code-point order; an empty table
gives an empty result; extra columns are ignored; a text is read whole (a task holds its words), and words
of any length take part (a cell holds two positions of its index at a time).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, release

#: Askers whose bitsets are walked at a time.
ASKED_AT_ONCE = 512
PAIR = "word string, other string, other_n long"


def letters(length: int) -> re.Pattern:
    """Maximal runs of so many letters or more, in texts whose A-Z are lower-cased."""
    return re.compile(f"[a-zÀ-ÿ]{{{length},}}")


def slips(doc_id: str | None, counts: Counter, one_in: int) -> Counter:
    """counts of one document's words, where of words whose hash with its id `one_in` divides a letter is deleted."""
    seed = zlib.crc32(f"{doc_id or ''}:".encode())
    out: Counter = Counter()
    for word, n in counts.items():
        h = zlib.crc32(word.encode(), seed)
        if h % one_in == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        out[word] += n
    return out


def vocabulary(docs: DataFrame, least_length: int = 6, least_n: int = 5, slip_one_in: int = 0, hold: int = 300_000) -> DataFrame:
    """word and n: words of `least_length` letters or more that occur `least_n` times or more. A task sends its counts
    on whenever it holds more than `hold` words."""
    word = letters(least_length)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                if not text:
                    continue
                # bytes are lower-cased in A-Z alone
                found = Counter(word.findall(text.encode().lower().decode()))
                total.update(slips(doc_id, found, slip_one_in) if slip_one_in else found)
            if len(total) > hold:
                yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                total.clear()
        if total:
            yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    sent = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = sent.mapInPandas(count, "word string, n long").where(F.length("word") >= least_length)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


class PositionIndex:
    """Bitsets by (position, letter) over words of length m and m + 1, made as the positions are walked."""

    def __init__(self, words: list[str], m: int):
        padded = "".join(w.ljust(m + 1, "\0") for w in words).encode("latin-1")
        self.codes = np.frombuffer(padded, np.uint8).reshape(len(words), m + 1)
        present = np.unique(self.codes)
        self.alphabet = present[present > 0]
        self.row = np.full(256, len(self.alphabet))  # letters that no word has: the empty bitset
        self.row[self.alphabet] = np.arange(len(self.alphabet))
        self.width = -(-len(words) // 64)
        lengths = (self.codes > 0).sum(axis=1)
        self.same, self.longer = self.bits((lengths == m)[None])[0], self.bits((lengths == m + 1)[None])[0]

    def bits(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros((len(flags), self.width * 8), np.uint8)
        packed = np.packbits(flags, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def position(self, j: int) -> np.ndarray:
        """One bitset for every letter of the alphabet, and the empty one."""
        rows = self.bits(self.codes[:, j][None] == self.alphabet[:, None])
        return np.concatenate([rows, np.zeros((1, self.width), np.uint64)])


def one_edit(index: PositionIndex, asked: list[str], m: int, split: int, front: bool) -> tuple[np.ndarray, np.ndarray]:
    """(asker, indexed word) at distance one, askers of length m. Bins by first halves, of `split` letters,
    give the pairs that have these equal, bins by last halves the others."""
    queries = index.row[np.frombuffer("".join(asked).encode("latin-1"), np.uint8).reshape(len(asked), m)]
    zero = np.full((len(asked), index.width), 0xFFFFFFFFFFFFFFFF, np.uint64)
    replaced, inserted, halves = np.zeros_like(zero), zero, zero
    here = index.position(0)
    for j in range(m):
        if j == split:
            halves = zero
        further = index.position(j + 1)
        match, match_further = here[queries[:, j]], further[queries[:, j]]
        replaced = (replaced & match) | (zero & ~match)
        zero = zero & match
        inserted = (inserted & match_further) | zero
        here = further
    found = (replaced & index.same) | (inserted & index.longer)
    found &= halves if front else ~halves
    asker, place = np.nonzero(found)
    bit, offset = np.nonzero(np.unpackbits(found[asker, place].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return asker[bit], place[bit] * 64 + offset


def near_words(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one cell, both ways where the lengths differ; those of one length ask each other."""
    m, front = int(key[0]), bool(key[1])
    indexed, asked = cell[cell["indexed"]], cell[cell["asks"]]
    words, word_n = indexed["word"].tolist(), indexed["n"].to_numpy()
    out = [pd.DataFrame({"word": [], "other": [], "other_n": []})]
    if words and len(asked):
        index = PositionIndex(words, m)
        names = np.array(words, object)
        for at in range(0, len(asked), ASKED_AT_ONCE):
            part = asked.iloc[at : at + ASKED_AT_ONCE]
            a, b = one_edit(index, part["word"].tolist(), m, m // 2, front)
            word, other = part["word"].to_numpy()[a], names[b]
            out.append(pd.DataFrame({"word": word, "other": other, "other_n": word_n[b]}))
            back = np.array([len(o) > m for o in other], bool)
            out.append(pd.DataFrame({"word": other[back], "other": word[back], "other_n": part["n"].to_numpy()[a][back]}))
    found = pd.concat(out)
    return found.astype({"word": object, "other": object, "other_n": "int64"})


def near_pairs(words: DataFrame, bin_words: int = 2048, cells: int = 8192) -> DataFrame:
    """(word, other, other_n), both ways, of words (word, n) that are distinct and one edit apart. Letters are
    U+0001 to U+00FF."""

    def role(m, asks: bool) -> list:
        """The bins of a word, as one of class m (of that length, or one letter longer)."""
        split = F.floor(m / 2).cast("int")
        half = {True: F.substring("word", F.lit(1), split), False: F.substring("word", split - m, m - split)}
        return [F.struct(m.alias("m"), F.lit(front).alias("front"), half[front].alias("half"), F.lit(asks).alias("asks")) for front in (True, False)]

    length = F.length("word")
    roles = words.select("word", "n", F.explode(F.array(*role(length, True), *role(length - 1, False))).alias("r")).select("word", "n", "r.*").where("m > 0")
    sizes = words.groupBy(F.length("word").alias("m")).agg(F.ceil(F.count("*") / bin_words).alias("bins"))
    binned = roles.join(sizes, "m").withColumn("bin", F.pmod(F.xxhash64("half"), F.col("bins"))).drop("bins", "half")
    full = binned.groupBy("m", "front", "bin").agg(F.count("*").alias("held")).select("m", "front", "bin", F.ceil(F.col("held") / cells).alias("side"))
    dealt = binned.join(full, ["m", "front", "bin"]).withColumn("own", F.pmod(F.xxhash64("word", F.lit(5)), F.col("side")))
    every = F.sequence(F.lit(0).cast("long"), F.col("side") - 1)
    # own as a row of the grid: indexed in all its columns; own as a column: asks in all its rows
    row = F.transform(every, lambda c: F.struct(F.col("own").alias("i"), c.alias("j"), F.lit(True).alias("indexed"), (F.col("asks") & (c == F.col("own"))).alias("asks")))
    column = F.transform(F.filter(every, lambda r: F.col("asks") & (r != F.col("own"))), lambda r: F.struct(r.alias("i"), F.col("own").alias("j"), F.lit(False).alias("indexed"), F.lit(True).alias("asks")))
    placed = dealt.select("m", "front", "bin", "word", "n", F.explode(F.concat(row, column)).alias("c")).select("m", "front", "bin", "word", "n", "c.*")
    return placed.groupBy("m", "front", "bin", "i", "j").applyInPandas(near_words, PAIR)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of forms (word, form): the last word that forms lead to. Forms have no cycle."""
    links = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialize(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(links)
        links = longer
        if not links.where("moved").limit(1).count():
            return links.drop("moved")


def variants(docs: DataFrame, least_length: int = 6, least_n: int = 5, ratio: int = 5, slip_one_in: int = 0) -> DataFrame:
    """For every word of the vocabulary: n, n_near (words one edit apart), form (the most frequent of these, if it is
    `ratio` times as frequent), form_n, and root, to which forms lead in the end."""
    words = materialize(vocabulary(docs, least_length, least_n, slip_one_in))
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    form = F.when(-F.col("best.minus") >= ratio * F.col("n"), F.col("best.other"))
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.minus")).alias("form_n"))
    judged = materialize(judged)
    release(words)
    led = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
