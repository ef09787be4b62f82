"""N-gram Jaccard join by parity sketches.

A document's set is its distinct shingles of five words. Sets are hashed into parts, and each part's
64-bit hashes are XORed: a parity sketch, in which every part that differs holds at least one
element of the symmetric difference. Two linked sets of sizes a and b differ in at most (a + b) / 7
elements, so of the m parts of their size band most are equal (pigeonhole), and documents meet
in equal parts only. All of this is exact: no link is lost, whatever the groups' sizes.

1. `classes`: documents with the same set are one class; only its smallest doc_id goes on.
2. `shared_parts`: part hashes are shuffled by range, as packed arrays; those of one class only end here.
3. `candidates`, `prefixes`: a class must share `need` parts with a partner. Ordered from the rarest part on, it is
   enough to keep all but the last need - 1; classes that share fewer than `need` parts have no
   partner. Passages that thousands of documents share thus cost nothing.
4. Two stars in every part (everyone with the class that has most in common with others, and with the
   first by key) are verified by intersecting the sets, and components built. Only parts that still hold
   several components are then paired across components, so a group of copies never makes all its
   pairs. Pairs whose sizes, or whose places in the order of rarity, rule a link out are never made.

Edge cases: a null or empty text, or one without words, has an empty set, links with nothing and is
its own component; fewer than five words are one shingle; equal rows are one class; a null doc_id
never names a component, but rows without one link as others do (a component without any id has the
component_id null); rows that share an id and differ in text are nodes of their own; a word of any length is one word; an empty
table gives an empty result. Texts are hashed a megabyte at a time; a text's set is held whole, eight
bytes a shingle. Sets of equal key, 128 bits, are taken for the same set.

Groups: a range of part hashes holds about `elements_per_range` of them, whatever the corpus; a part that
very many classes have is dealt to cells of `cell` classes. What remains quadratic are classes of about one size
that share parts and lie just below the threshold: their pairs are compared by bit sketches, 64 bits
at a time, and only those that the sketches can't rule out are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import map_rows, materialize, narrow, release
from palimpsest.llm.components import components

WORDS = 5
U = np.uint64
BASE, INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLANKS = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
#: Bytes that are hashed at a time: bounds a task's memory.
CHUNK = 1 << 20
#: Part hashes that are sorted and packed at a time; copies are told apart within such a block.
PER_BLOCK = 1_500_000
#: Size bands: a band's largest set, and its number of parts.
GROWTH, SMALLEST, PARTS_PER_ELEMENT, LEAST_PARTS = 1.8, 8, 0.8, 64
#: A sketch's owner in a packed block: set key, set size with the top bit for the next band up, parts that aren't empty.
OWNER = np.dtype([("hi", "<i8"), ("lo", "<i8"), ("size", "<u4"), ("filled", "<u4")])
NEXT = 1 << 31
#: Ranges of part hashes, at least: a small corpus is spread over the cluster too.
LEAST_RANGES = 64
#: Rows that a range sends on at a time: neither Python nor the JVM holds a range's rows at once.
ROWS_AT_ONCE = 100_000
#: Bits of a Hamming sketch for each element of a set, at least.
BITS_PER_ELEMENT = 2


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def finished(polynomial: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Word hashes from their polynomials."""
    return mix(polynomial + length * U(0xD6E8FEB86659FD93))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(CHUNK + 1, base, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Shingler:
    """Hashes words of many texts at once: differences of a prefix polynomial, mixed."""

    def __init__(self) -> None:
        self.powers, self.inverses = _powers()

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of each word of data, at most CHUNK bytes."""
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        prefix = np.concatenate([[U(0)], np.cumsum(data.astype(U) * self.powers[: len(data)], dtype=U)])
        return starts, finished((prefix[ends] - prefix[starts]) * self.inverses[starts], (ends - starts).astype(U))

    def text_words(self, text: bytes) -> np.ndarray:
        """Word hashes of one text of any length, cut at white space; a word longer than a chunk is carried
        through all its chunks."""
        data, out, at = np.frombuffer(text, np.uint8), [], 0
        while at < len(text):
            end = min(at + CHUNK, len(text))
            cut = max(text.rfind(s, at, end) for s in BLANKS) if end < len(text) else end
            if cut < at:  # no white space in this chunk
                value, length, end = self.long_word(data, at)
                out.append(finished(np.array([value], U), np.array([length], U)))
            else:
                end = max(cut, at + 1)
                out.append(self.words(data[at:end])[1])
            at = end
        return np.concatenate(out) if out else np.zeros(0, U)

    def long_word(self, data: np.ndarray, at: int) -> tuple[int, int, int]:
        """(polynomial, length, end) of the word that starts at `at`."""
        value, start = 0, at
        while at < len(data):
            part = data[at : at + CHUNK]
            blank = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
            part = part[: blank[0]] if len(blank) else part
            piece = int(np.add.reduce(part.astype(U) * self.powers[: len(part)], dtype=U))
            value = (value + piece * pow(int(BASE), at - start, 1 << 64)) % (1 << 64)
            at += len(part)
            if len(blank):
                break
        return value, at - start, at

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Each text's set: sorted distinct 64-bit shingle hashes."""
        lowered = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        i = 0
        while i < len(lowered):
            if len(lowered[i]) >= CHUNK:
                yield shingles(self.text_words(lowered[i]))
                i += 1
                continue
            j, size = i, 0
            while j < len(lowered) and size + len(lowered[j]) + 1 <= CHUNK:
                size += len(lowered[j]) + 1
                j += 1
            data = np.frombuffer(b"\n".join(lowered[i:j]), np.uint8)
            starts, hashes = self.words(data)
            ends = np.cumsum([len(t) + 1 for t in lowered[i:j]])
            for part in np.split(hashes, np.searchsorted(starts, ends[:-1])):
                yield shingles(part)
            i = j


def shingles(words: np.ndarray) -> np.ndarray:
    n = min(len(words), WORDS)
    if not n:
        return words
    h = np.full(len(words) - n + 1, n, U)
    for k in range(n):
        h = h * U(0xC6A4A7935BD1E995) + words[k : len(words) - n + 1 + k]
    return np.unique(mix(h))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of the whole set, as two signed longs."""
    return tuple(int(np.add.reduce(mix(s, k), dtype=U).astype(np.int64)) for k in (1, 2))


def bands() -> list[tuple[int, int]]:
    """(largest set, parts), up to sets of some billions."""
    out, top = [], float(SMALLEST)
    while top < 1 << 33:
        out.append((int(top), max(LEAST_PARTS, int(PARTS_PER_ELEMENT * int(top)) + 3)))
        top *= GROWTH
    return out


BANDS = bands()
TOPS = np.array([top for top, _ in BANDS])
PARTS = np.array([m for _, m in BANDS])


def differences(size, band):
    """The most elements in which a set of this size can differ from a partner in its band."""
    return (size + np.minimum(4 * size // 3, TOPS[band])) // 7


def parts(s: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(0 or NEXT, parts that aren't empty, part hashes) of a set: in its own band, and in the next one if a
    larger partner may be there. A set with so few filled parts that empty ones might be all that is
    equal gets one more hash, in which such sets meet."""
    n = len(s)
    own = int(np.searchsorted(TOPS, n))
    element, place = mix(s, 3), mix(s, 4) >> U(32)
    for band in (own, own + 1) if 4 * n // 3 > TOPS[own] else (own,):
        part = (place * U(BANDS[band][1])) >> U(32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sketch = mix(np.bitwise_xor.reduceat(element[order], first) ^ (part[first] * U(0x9FB21C651E98DF25)) ^ U(band + 1))
        if len(first) <= differences(n, band):
            sketch = np.concatenate([sketch, mix(np.array([band], U), 5)])
        yield NEXT * (band > own), len(first), sketch


def planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of x, plane by plane: sorted values compress well so."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    x = np.zeros((len(data) // width, 8), np.uint8)
    x[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return x.view("<u8").ravel()


def classes(docs: DataFrame) -> DataFrame:
    """docs without its text, with n_shingles, hi, lo: each row's set size and key."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for b in batches:
            rows = [(len(s), *set_key(s)) for s in shingler.sets(b["text"].tolist())]
            out = pd.DataFrame(rows, columns=["n_shingles", "hi", "lo"])
            yield pd.concat([b[kept].reset_index(drop=True), out], axis=1)

    return map_rows(docs, kept, ["text"], run, "n_shingles long, hi long, lo long")


def shared_parts(docs: DataFrame, ranges: int) -> DataFrame:
    """(sig, key, band, parts, size, filled, need, length, n): packed part hashes that n > 1 classes of a band have, a
    row for each such class with its set's size, its filled parts, how many part hashes a partner must share
    and how many it has. A range is one of `ranges` equal stretches of the hashes' upper 32 bits."""

    def block(owners: list[tuple[int, int, int, int]], sigs: list[np.ndarray]) -> pd.DataFrame:
        sig = np.concatenate(sigs)
        owner = np.repeat(np.arange(len(sigs), dtype=np.int32), [len(x) for x in sigs])
        order = np.argsort(sig)
        sig, owner = sig[order], owner[order]
        bucket = ((sig >> U(32)) * U(ranges)) >> U(32)
        edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(sig))
        table = np.array(owners, OWNER)
        rows = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            used, local = np.unique(owner[lo:hi], return_inverse=True)
            rows.append((int(bucket[lo]), planes(sig[lo:hi], 8), planes(local, 4), table[used].tobytes()))
        return pd.DataFrame(rows, columns=["r", "sigs", "owners", "table"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        owners: list[tuple[int, int, int, int]] = []
        sigs: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        held = 0
        for b in batches:
            for s in shingler.sets(b["text"].tolist()):
                key = set_key(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                for up, filled, sig in parts(s):
                    owners.append((*key, len(s) | up, filled))
                    sigs.append(sig)
                    held += len(sig)
                if held >= PER_BLOCK:
                    yield block(owners, sigs)
                    owners, sigs, seen, held = [], [], set(), 0
        if sigs:
            yield block(owners, sigs)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sigs, tables, owners, base = [], [], [], 0
        for blobs in batches:
            for a, b, c in zip(blobs["sigs"], blobs["owners"], blobs["table"], strict=True):
                sigs.append(from_planes(a, 8))
                owners.append((from_planes(b, 4) + U(base)).astype(np.int32))
                tables.append(np.frombuffer(c, OWNER))
                base += len(tables[-1])
        sig, owner, table = np.concatenate(sigs), np.concatenate(owners), np.concatenate(tables)
        del sigs, owners, tables
        # a class that several blocks have in one band has one row of the table
        order = np.lexsort((table["size"], table["lo"], table["hi"]))
        table = table[order]
        fresh = np.concatenate([[True], table[1:] != table[:-1]])
        row = np.empty(len(table), np.int32)
        row[order] = np.cumsum(fresh, dtype=np.int32) - 1
        table, owner = table[fresh], row[owner]
        sig, owner, _ = shared(sig, owner, np.argsort(sig, kind="stable"))
        order = np.lexsort((owner, sig))
        again = (np.diff(sig[order]) == 0) & (np.diff(owner[order]) == 0)
        sig, owner, n = shared(sig, owner, order[np.concatenate([np.ones(min(1, len(order)), bool), ~again])])
        del order, again
        size = (table["size"] & np.uint32(NEXT - 1)).astype(np.int64)
        band = np.searchsorted(TOPS, size) + (table["size"] >= NEXT)
        filled, most = table["filled"].astype(np.int64), differences(size, band)
        facts = {"hi": table["hi"], "lo": table["lo"], "band": band, "parts": PARTS[band], "size": size, "filled": filled, "need": np.maximum(filled - most, 1), "length": filled + (filled <= most)}
        narrow_to = {name: v if name in ("hi", "lo") else v.astype(np.int32) for name, v in facts.items()}
        for at in range(0, len(sig), ROWS_AT_ONCE):
            part = slice(at, at + ROWS_AT_ONCE)
            yield pd.DataFrame({"sig": sig[part].view(np.int64), **{name: v[owner[part]] for name, v in narrow_to.items()}, "n": n[part]})

    def shared(sig: np.ndarray, owner: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sig, owner, n) in this order, which sorts by sig: those whose sig is there n > 1 times."""
        sig = sig[order]
        edges = np.flatnonzero(np.concatenate([np.ones(min(1, len(sig)), bool), sig[1:] != sig[:-1]]))
        n = np.diff(np.append(edges, len(sig))).astype(np.int32)
        n = np.repeat(n, n)
        many = n > 1
        return sig[many], owner[order[many]], n[many]

    schema = "sig long, hi long, lo long, band int, parts int, size int, filled int, need int, length int, n int"
    packed = docs.mapInPandas(emit, "r int, sigs binary, owners binary, table binary")
    met = packed.repartitionById(ranges, F.col("r").cast("int")).groupBy("r").applyInPandas(meet, schema)  # a task a range
    return met.select("sig", F.struct("hi", "lo").alias("key"), "band", *[F.col(c).cast("long").alias(c) for c in ("parts", "size", "filled", "need", "length", "n")])


def candidates(shared: DataFrame) -> DataFrame:
    """A row per class and band that shares `need` parts or more: its counts, and the sigs it shares, rarest
    first. A class's own parts bound the list."""
    own = ("key", "band", "parts", "size", "filled", "need", "length")
    sigs = F.array_sort(F.collect_list(F.struct("n", "sig")))
    return shared.groupBy(*own).agg(sigs.alias("sigs")).where(F.size("sigs") >= F.col("need")).withColumn("sigs", F.transform("sigs", lambda s: s["sig"]))


def prefixes(found: DataFrame) -> DataFrame:
    """(sig, key, band, parts, size, filled, length, place): the rarest parts of each candidate, one of which any
    partner has too; place counts from 1 in the order of rarity, parts that nobody shares first."""
    s = F.size("sigs")
    rows = found.select("*", s.alias("s"), F.posexplode(F.slice("sigs", F.lit(1), (s - F.col("need") + 1).cast("int"))).alias("k", "sig"))
    return rows.select("sig", "key", "band", "parts", "size", "filled", "length", (F.col("length") - F.col("s") + F.col("k") + 1).alias("place"))


def bit_sketches(sets: DataFrame) -> DataFrame:
    """(key, bits): each set's elements XORed into single bits, at least BITS_PER_ELEMENT for each element of its
    band's largest set. The Hamming distance of two such sketches of one length bounds the sets' symmetric
    difference from below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for hi, lo, elements in zip(b["hi"], b["lo"], b["elements"], strict=True):
                s = np.asarray(elements, np.int64).astype(U)
                width = 64 << int(np.ceil(np.log2(max(1, int(TOPS[np.searchsorted(TOPS, len(s))]) * BITS_PER_ELEMENT / 64))))
                bits = (np.bincount((mix(s, 6) & U(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)
                rows.append((hi, lo, np.packbits(bits, bitorder="little").view("<i8")))
            yield pd.DataFrame(rows, columns=["hi", "lo", "bits"])

    return sets.select("hi", "lo", "elements").mapInPandas(run, "hi long, lo long, bits array<long>").select(F.struct("hi", "lo").alias("key"), "bits")


def possible(a: str, b: str) -> Column:
    """Whether two classes that meet in a part, and in no rarer one, can be linked: by their sizes, and by
    the parts that are left in either's order. Both bounds are exact."""
    x, y = (lambda c, p=p: F.col(f"{p}.{c}") for p in (a, b))
    left = F.least(x("length") - x("place"), y("length") - y("place")) + 1
    equal = left + F.least(x("parts") - x("filled"), y("parts") - y("filled"))
    sizes = (4 * x("size") >= 3 * y("size")) & (4 * y("size") >= 3 * x("size"))
    return sizes & (equal >= x("parts") - F.floor((x("size") + y("size")) / 7))


def sets_of(docs: DataFrame, wanted: DataFrame, broadcast_rows: int) -> DataFrame:
    """(hi, lo, node, n, elements) of the classes in wanted(rep, hi, lo, node): texts are found by their class's
    smallest doc_id; those of classes without an id by their sets."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for b in batches:
            rows = []
            for node, hi, lo, s in zip(b["node"], b["hi"], b["lo"], shingler.sets(b["text"].tolist()), strict=True):
                key = set_key(s)
                if len(s) and (node < 0 or key == (hi, lo)):
                    rows.append((*key, node, len(s), s.astype(np.int64)))
            yield pd.DataFrame(rows, columns=["hi", "lo", "node", "n", "elements"])

    schema = "hi long, lo long, node long, n long, elements array<long>"
    named = docs.join(narrow(wanted.where("rep is not null"), broadcast_rows), docs["doc_id"] == wanted["rep"]).select("node", "hi", "lo", "text")
    nameless = docs.where("doc_id is null").select(F.lit(-1).cast("long").alias("node"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), "text")
    keyed = nameless.mapInPandas(sets, schema).drop("node").join(wanted.where("rep is null").select("hi", "lo", "node"), ["hi", "lo"])
    return named.mapInPandas(sets, schema).unionByName(keyed).dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): nodes of the pairs(a, b) of classes whose sets are similar enough."""

    def side(x: str) -> DataFrame:
        return sets.select(F.struct("hi", "lo").alias(x), F.col("node").alias(f"node_{x}"), F.col("n").alias(f"n_{x}"), F.col("elements").alias(f"elements_{x}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("elements_a", "elements_b"))
    linked = both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common")))
    return linked.select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))


MEMBER = ("key", "parts", "size", "filled", "length", "place")


def paired(met: DataFrame) -> DataFrame:
    """(a, b), a < b: of rows with members x and y, those that can be linked."""
    ordered = met.where("x.key <> y.key").where(possible("x", "y"))
    return ordered.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def star_pairs(prefix: DataFrame) -> DataFrame:
    """In every part, each class with the one that has most in common with others and with the first one by key."""
    member = prefix.select("sig", F.struct(*MEMBER).alias("x"))
    hubs = member.groupBy("sig").agg(F.min_by("x", F.struct("x.place", "x.key")).alias("y"), F.min_by("x", "x.key").alias("z"))
    met = member.join(hubs, "sig")
    return paired(met.select("x", F.explode(F.array("y", "z")).alias("y")))


def crossing_pairs(prefix: DataFrame, component: DataFrame, tested: DataFrame, bits: DataFrame, cell: int = 2000) -> DataFrame:
    """Untested pairs of one part but different components. In each part, classes outside its largest
    component meet all others: members of one component never meet, nor do classes whose sketches
    are further apart than linked ones can be. The classes of a large part are dealt to cells, each of
    which the others meet in a group of its own."""
    known = prefix.join(component, "key").select("sig", "component", F.struct(*MEMBER).alias("x"))
    sizes = known.groupBy("sig", "component").agg(F.count("*").alias("n"))
    major = sizes.groupBy("sig").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("kinds"), F.ceil(F.sum("n") / cell).cast("int").alias("cells")).where("kinds > 1").drop("kinds")
    mixed = materialize(known.join(major, "sig").join(bits, F.col("x.key") == bits["key"]).drop("key"))
    few = mixed.where("component <> major").select(F.col("sig").alias("part"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("at"), "x", F.col("component").alias("other"), F.col("bits").alias("bits_x"))
    many = mixed.select("sig", F.pmod(F.xxhash64("x.key"), F.col("cells")).cast("int").alias("cell"), "component", F.col("x").alias("y"), F.col("bits").alias("bits_y"))
    # sketches of different lengths are compared no further
    differ = F.aggregate(F.zip_with("bits_x", "bits_y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)
    apart = (F.size("bits_x") == F.size("bits_y")) & (differ > F.floor((F.col("x.size") + F.col("y.size")) / 7))
    met = few.join(many, (F.col("part") == F.col("sig")) & (F.col("at") == F.col("cell")) & (F.col("other") != F.col("component")) & possible("x", "y") & ~apart)
    return paired(met.select("x", "y")).join(tested, ["a", "b"], "left_anti")


def labelled(docs: DataFrame, percent: int = 75, elements_per_range: int = 3_000_000, broadcast_rows: int = 2_000_000) -> DataFrame:
    """docs(row.., text) with n_shingles, its class hi, lo, and component: the smallest (rep, hi, lo) of the classes
    that links reach, rep being a class's smallest doc_id. Empty sets have no class and no component."""
    if percent < 75:
        raise ValueError("the sketches' bounds hold from 75 percent on")
    texts = docs.select("doc_id", "text")
    keys = materialize(classes(docs))
    filled = keys.where("n_shingles > 0")
    total = filled.agg(F.sum("n_shingles")).first()[0] or 0
    reps = filled.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
    close = materialize(candidates(shared_parts(texts, max(LEAST_RANGES, -(-total // elements_per_range)))))
    prefix = materialize(prefixes(close))
    release(close)
    used = prefix.select("key.hi", "key.lo").distinct()
    # classes that may have a partner are numbered: 64 bits without a collision, for the links and components
    wanted = materialize(reps.join(used, ["hi", "lo"], "left_semi").withColumn("node", F.monotonically_increasing_id()))
    sets = materialize(sets_of(texts, wanted, broadcast_rows))
    stars = materialize(star_pairs(prefix))
    links = materialize(verified(stars, sets, percent))
    label = components(links)
    found = materialize(sets.select("hi", "lo", "node").join(label, "node", "left").select(F.struct("hi", "lo").alias("key"), F.coalesce("component", "node").alias("component")))
    crossing = materialize(crossing_pairs(prefix, found, stars, bit_sketches(sets)))
    more = materialize(verified(crossing, sets, percent))
    if not more.isEmpty():
        release(label)
        label = components(links.unionByName(more))
    linked = wanted.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    place = F.struct(F.col("rep").isNull(), F.struct("rep", "hi", "lo").alias("class"))  # a class without an id comes last
    firsts = linked.groupBy("component").agg(F.min(place)["class"].alias("first"))
    other = materialize(linked.join(firsts, "component").select("hi", "lo", "first").where("hi <> first.hi or lo <> first.lo"))
    release(prefix, wanted, sets, stars, found, crossing, links, more, label)
    named = reps.join(narrow(other, broadcast_rows), ["hi", "lo"], "left").select("hi", "lo", F.coalesce("first", F.struct("rep", "hi", "lo")).alias("component"))
    none = F.lit(None).cast(named.schema["component"].dataType).alias("component")
    return filled.join(named, ["hi", "lo"]).select(*keys.columns, "component").unionByName(keys.where("n_shingles = 0").select("*", none))


def jaccard_components(docs: DataFrame, percent: int = 75, **params) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs; percent must be 75 or more."""
    found = labelled(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), percent, **params)
    return found.select("doc_id", "n_shingles", F.coalesce("component.rep", F.when(F.col("n_shingles") == 0, F.col("doc_id"))).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 75, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Rows of docs, all columns as they came, of which near-duplicate links, or equality, connect no two: of
    each component the row with the smallest id stays (null ids last, then by the text's hash); of rows that
    share id and text any one. Rows without words link with nothing and stay, equal ones of them too."""
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    rows = materialize(labelled(slim, percent).where("n_shingles > 0").select("doc_id", "text_hash", F.col("component").alias("group")))
    firsts = rows.groupBy("group").agg(F.min(place).alias("first"))
    known = rows.distinct().join(firsts, "group").select("doc_id", "text_hash", (place != F.col("first")).alias("later"))
    counted = rows.groupBy("doc_id", "text_hash").agg((F.count("*") > 1).alias("repeated"))
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_hash") == F.col("c.text_hash"))
    marked = known.alias("d").join(counted.alias("c"), same).select(F.col("d.doc_id").alias("row_id"), F.col("d.text_hash").alias("row_hash"), "later", "repeated")
    marked = materialize(marked.where("later or repeated").distinct())
    release(rows)
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    joined = row.join(narrow(marked, broadcast_rows), F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("text_hash") == F.col("row_hash")), "left")
    once = joined.where(~F.coalesce("later", F.lit(False)))
    single = once.where(~F.coalesce("repeated", F.lit(False))).select("row.*")
    # few: only rows that share id and text are gathered to choose one
    return single.unionByName(once.where("repeated").dropDuplicates(["doc_id", "text_hash"]).select("row.*"))
