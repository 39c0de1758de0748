"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds its distinct shingles of five words (fewer words: the whole sequence). Two documents link when
100 * intersection >= 80 * union. The join finds every such link between different sets without comparing all pairs:

1. Every shingle's document frequency is counted over the whole corpus: units of texts send packed hashes to parts of the
   hash space (exchange), which answer with the counts of shingles that occur more than once. A set's order is by frequency,
   then hash; shingles that occur once come first and can't be shared, so they take up prefix places without a row.
2. Each set emits its prefix: two sets that link share a shingle within their first n - ceil(0.8 n) + 1. The smaller of the two
   has it even within its first n - ceil(8 n / 9) + 1, its early places. Equal sets are one set from here on (copies never
   multiply). Rows meet by shingle; shingles without an early place can't make a pair.
3. Of the sets that share a prefix shingle, each is first paired with one of that shingle. Pairs that pass the length,
   positional and suffix filters are verified, and components formed.
4. What is left to decide are pairs of different components, not tried before. Those that share a prefix shingle, early in the
   smaller set, and pass the filters are verified too. Members of one component are never paired again, so large groups of
   near copies don't multiply, and no link between components is lost.

The suffix filter bounds the overlap by counts of hashes in RANGES ranges, before any text is fetched. Verification fetches
the texts of both sets and takes the exact intersection. Hashes that meet have 48 bits: a collision makes a candidate or shifts
a frequency, never a link.

Defined cases: null or wordless text has the empty set and links with nothing; a null doc_id links with nothing and has a
null component; rows of one doc_id are one document to classes() (each keeps its row, they share their links) and documents
of their own to representatives(); an empty table gives an empty result; ties (equal sets) take the smallest doc_id; other
columns are ignored by classes() and kept by representatives().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.components import components

from . import common, exchange, hashing, idfilter

#: Bits of a hash that meets others; the low 16 bits beside it hold its text's place in a unit.
BITS, PLACE_BITS = 48, 16
#: Hash ranges of the suffix filter.
RANGES = 32
SENT = "unit long, part int, buckets binary, rest binary, places binary, docs array<long>, marks array<long>, sizes array<int>, sigs array<long>, hists array<binary>"
ANSWERED = "unit long, ids binary, counts binary, places binary, docs array<long>, marks array<long>, sizes array<int>, sigs array<long>, hists array<binary>"
ROWS = "doc_id long, mark long, n int, sig long, hist binary, shingles array<long>, places array<int>"


@dataclass(frozen=True)
class Rule:
    """Link if shared / union >= part / of, for shingles of words words."""

    words: int = 5
    part: int = 80
    of: int = 100

    def prefix(self, n):
        """The length of the prefix of a set of n (a number, array or column)."""
        return n - -(-self.part * n // self.of) + 1

    def links(self, shared, a, b):
        return self.of * shared >= self.part * (a + b - shared)


def signature(own: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    return int(hashing.mix(np.array([hashing.mix(own ^ np.uint64(hashing.BASE)).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64)).view(np.int64)[0])


def histogram(own: np.ndarray) -> bytes:
    """Counts by hash range, rounded up to a scale by size that fits in bytes; 255 is no bound."""
    return np.minimum(-(-np.bincount((own >> np.uint64(59)).astype(np.int64), minlength=RANGES) // scale(len(own))), 255).astype(np.uint8).tobytes()


def scale(n):
    return 1 + n // 2048


def most_shared(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """An upper bound of the intersection, a row a pair, from histograms and sizes."""
    bound = lambda h, n: np.where(h == 255, n[:, None], h.astype(np.int64) * scale(n)[:, None])
    return np.minimum(bound(a, na), bound(b, nb)).sum(axis=1)


def sent(docs: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """Of each unit of docs (doc_id, mark, text): a row a part with its hashes, and one row with the unit's documents.

    Equal sets of a unit send their hashes once, from the first of them; documents without an id send none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        for batch in common.units(batches, "text", exchange.UNIT_BYTES, exchange.UNIT_ROWS):
            docs, marks = common.strings(batch, "doc_id"), common.strings(batch, "mark")
            seen: set[tuple[int, int]] = set()
            hashes, sizes, sigs, hists = [], [], [], []
            for place, (doc, text) in enumerate(zip(docs, common.raw(batch, "text"), strict=True)):
                own = hashing.shingles(text, rule.words)
                sizes.append(len(own))
                sigs.append(signature(own))
                hists.append(histogram(own) if len(own) else None)
                if doc is not None and len(own) and (key := (sigs[-1], len(own))) not in seen:
                    seen.add(key)
                    hashes.append((own >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.uint64(place))
            rows = [(unit, unit % parts, None, None, None, docs, marks, sizes, sigs, hists)]
            if hashes:
                both = np.sort(np.concatenate(hashes))
                values, places = both >> np.uint64(PLACE_BITS), (both & np.uint64((1 << PLACE_BITS) - 1)).astype("<u2")
                rows += [(unit, part, buckets, rest, places[low:high].tobytes(), None, None, None, None, None) for part, low, high, buckets, rest in exchange.pack(values, BITS, parts)]
            unit += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*rows, strict=True)), schema, strict=True)], schema=schema)

    schema = common.arrow_schema(SENT)
    common.bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "mark", "text").mapInArrow(run, SENT)


def _answered(parts: int):
    """Counts the hashes of a part over all units; answers each unit with those that occur more than once."""
    schema = common.arrow_schema(ANSWERED)
    passed = ("docs", "marks", "sizes", "sigs", "hists")

    def answer(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, hashes, places = [], [], []
        for batch in batches:
            columns = {name: batch.column(batch.schema.get_field_index(name)) for name in batch.schema.names}
            own = columns["rest"].is_valid()
            told = pa.compute.invert(own)
            if pa.compute.any(told).as_py():
                kept = [columns[c].filter(told) for c in ("unit", *passed)]
                nothing = pa.nulls(len(kept[0]), pa.binary())
                yield pa.RecordBatch.from_arrays([kept[0], nothing, nothing, nothing, *(c.cast(f.type) for c, f in zip(kept[1:], list(schema)[4:], strict=True))], schema=schema)
            for unit, buckets, rest, place in zip(*(columns[c].filter(own).to_pylist() for c in ("unit", "buckets", "rest", "places")), strict=True):
                units.append(unit)
                hashes.append(exchange.unpack(key[0].as_py(), BITS, parts, buckets, rest))
                places.append(np.frombuffer(place, "<u2"))
        if not hashes:
            return
        ordered = np.sort(np.concatenate(hashes))
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(edges, len(ordered)))
        shared, counts = ordered[edges][counts > 1], counts[counts > 1]
        if not len(shared):
            return
        for unit, own, place in zip(units, hashes, places, strict=True):
            at = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
            hit = shared[at] == own
            if hit.any():
                row = [unit, own[hit].astype("<u8").tobytes(), counts[at[hit]].astype("<i8").tobytes(), place[hit].tobytes(), None, None, None, None, None]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return answer


def _placed(rule: Rule):
    """ROWS of a unit: its documents, with the prefix shingles that others have too and their places in the set's order."""
    schema = common.arrow_schema(ROWS)

    def place(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, ids, counts, places = None, [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["ids"] is None:
                    told = row
                else:
                    ids.append(np.frombuffer(row["ids"], "<u8"))
                    counts.append(np.frombuffer(row["counts"], "<i8"))
                    places.append(np.frombuffer(row["places"], "<u2"))
        sizes = np.array(told["sizes"], np.int64)
        found, at = np.zeros(0, np.int64), np.zeros(0, np.int32)
        ends = np.zeros(len(sizes), np.int64)
        if ids:
            ids, counts, places = np.concatenate(ids), np.concatenate(counts), np.concatenate(places).astype(np.int64)
            order = np.lexsort((ids, counts, places))
            ids, places = ids[order], places[order]
            shared = np.bincount(places, minlength=len(sizes))
            first = np.cumsum(shared) - shared
            rank = sizes[places] - shared[places] + np.arange(len(places)) - first[places]  # shingles of the set alone come before
            kept = rank < rule.prefix(sizes)[places]
            found, at, ends = ids[kept].view(np.int64), rank[kept].astype(np.int32), np.cumsum(np.bincount(places[kept], minlength=len(sizes)))
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(values)) for values in (found, at)]
        columns = [told["docs"], told["marks"], told["sizes"], told["sigs"], told["hists"], *lists]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return place


def placed(docs: DataFrame, rule: Rule) -> DataFrame:
    """ROWS, a row a row of docs (doc_id, mark, text)."""
    parts = exchange.parts_of(docs)
    answers = sent(docs, rule, parts).groupBy("part").applyInArrow(_answered(parts), ANSWERED)
    return answers.groupBy("unit").applyInArrow(_placed(rule), ROWS)


def marked(docs: DataFrame, name: str = "mark") -> DataFrame:
    """docs with a hash of doc_id and text."""
    return docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def passes(rule: Rule, n: str, place: str, n2: str, place2: str):
    """Length filter, and positional filter: what may still be shared from here on suffices."""
    a, b = F.col(n).cast("long"), F.col(n2).cast("long")
    least = F.ceil(rule.part * (a + b) / F.lit(rule.part + rule.of))
    left = 1 + F.least(a - 1 - F.col(place), b - 1 - F.col(place2))
    return (rule.of * F.least(a, b) >= rule.part * F.greatest(a, b)) & (left >= least)


def early(rule: Rule, n: str = "n", place: str = "place"):
    """Whether a place is among those where the smaller set of a linked pair has the first shared shingle."""
    return F.col(place) < F.col(n) - F.ceil(2 * rule.part * F.col(n) / F.lit(rule.part + rule.of)) + 1


def filtered(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (u, v) of sets, once each, that the suffix filter leaves. Only sizes and histograms of sets in a pair move."""
    one = common.written(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    ids = one.select(F.col("u").alias("sig")).union(one.select("v")).distinct()
    own = common.written(sets.join(ids, "sig", "left_semi").select("sig", "n", "hist"), "candidates")
    side = lambda c: own.select(F.col("sig").alias(c), F.col("n").alias(f"n_{c}"), F.col("hist").alias(f"h_{c}"))
    both = one.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "h_u", "n_v", "h_v")

    def start():
        def step(batch):
            n = [batch.column(k).to_numpy().astype(np.int64) for k in (2, 4)]
            h = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, RANGES) for k in (3, 5)]
            mask = pa.array(rule.links(most_shared(h[0], n[0], h[1], n[1]), *n))
            return [batch.column(k).filter(mask) for k in (0, 1)]

        return step

    return common.arrow_map(both, "u long, v long", start, None)


def linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (u, v) of sets that link, each verified once. Only texts of sets in a pair move. docs has mark."""
    one = common.written(filtered(pairs, sets, rule), "filtered")
    ids = one.select(F.col("u").alias("sig")).union(one.select("v")).distinct()
    wanted = common.written(sets.join(ids, "sig", "left_semi").select("sig", "mark"), "wanted")
    near = idfilter.divided(docs, wanted, "mark", "mark")[0].join(wanted, "mark")
    texts = common.written(near.groupBy("sig").agg(F.any_value("text").alias("text")), "texts")
    fetched = one.join(texts.select(F.col("sig").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("sig").alias("v"), F.col("text").alias("b")), "v")

    def start():
        kept: dict[bytes, np.ndarray] = {}

        def of(text: bytes) -> np.ndarray:
            if text not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[text] = hashing.shingles(text, rule.words)
            return kept[text]

        def step(batch):
            sets = [(of(a), of(b)) for a, b in zip(common.raw(batch, "a"), common.raw(batch, "b"), strict=True)]
            mask = pa.array([rule.links(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)) for a, b in sets], pa.bool_())
            return [batch.column(batch.schema.get_field_index(c)).filter(mask) for c in ("u", "v")]

        return step

    return common.arrow_map(fetched.select("u", "v", "a", "b"), "u long, v long", start, "a")


def prefixes(rows: DataFrame) -> DataFrame:
    """shingle, sig, n, place of the sets' prefixes, once a set."""
    own = rows.filter(F.size("shingles") > 0).select("sig", "n", F.explode(F.arrays_zip("shingles", "places")).alias("p"))
    return own.groupBy(F.col("p.shingles").alias("shingle"), "sig").agg(F.max("n").alias("n"), F.min("p.places").alias("place"))


def shared_prefixes(prefix: DataFrame, rule: Rule) -> DataFrame:
    """prefix where different sets share a shingle, one of them early; with the set that has it earliest (p_...)."""
    heads = prefix.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.max(early(rule)).alias("any"), F.min(F.struct("place", "sig", "n")).alias("p")).filter("k > 1 and any")
    # Written, so that both sides of the join are plain exchanges and a hot shingle's rows can be split.
    first = common.written(heads.select("shingle", F.col("p.sig").alias("p_sig"), F.col("p.n").alias("p_n"), F.col("p.place").alias("p_place")), "heads")
    return prefix.join(first, "shingle")


def crossing(shared: DataFrame, found: DataFrame, tried: DataFrame, rule: Rule) -> DataFrame:
    """u, v of sets of different components that share a prefix shingle, early in the smaller set, and were not tried."""
    whole = shared.select("shingle", "sig", "n", "place").join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    whole = common.written(whole, "shared")
    sizes = whole.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("size"))
    open_ = sizes.groupBy("shingle").agg(F.max(F.struct("size", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    major = common.written(open_.select("shingle", F.col("top.component").alias("major")), "open")
    rest = common.written(whole.join(major, "shingle").withColumn("early", early(rule)), "rest")
    other = rest.select("shingle", *(F.col(c).alias(f"r_{c}") for c in ("sig", "n", "place", "component", "major")))
    smaller = (F.col("component") != F.col("r_component")) & (F.struct("n", "sig") < F.struct("r_n", "r_sig")) & passes(rule, "n", "place", "r_n", "r_place")
    minor = rest.filter("early and component <> major").join(other, "shingle").filter(smaller)
    of_major = rest.filter("early and component = major").join(other.filter("r_component <> r_major"), "shingle").filter(smaller)
    pairs = minor.select("sig", "r_sig").union(of_major.select("sig", "r_sig")).select(F.least("sig", "r_sig").alias("u"), F.greatest("sig", "r_sig").alias("v")).distinct()
    return pairs.join(tried, ["u", "v"], "left_anti")


def several(rows: DataFrame) -> DataFrame:
    """u, v: links between the sets of one doc_id."""
    own = rows.filter("n > 0 and doc_id is not null").select("doc_id", "sig").distinct()
    first = common.written(own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.min("sig").alias("least")).filter("k > 1").select("doc_id", "least"), "several")
    return own.join(first, "doc_id").filter("sig <> least").select(F.col("sig").alias("u"), F.col("least").alias("v"))


def grouped(docs: DataFrame, rule: Rule, by_id: bool) -> tuple[DataFrame, ...]:
    """ROWS of docs (with mark), the sets' first documents (sig, doc_id, mark), and the first document of linked sets' groups.

    by_id: rows of one doc_id link. Tables between are removed.
    """
    with common.scope() as own:
        return own.keep(*_grouped(docs, rule, by_id))


def _grouped(docs: DataFrame, rule: Rule, by_id: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "mark")
    named = every.filter("doc_id is not null and text is not null")
    rows = common.written(placed(every, rule), "rows")
    sets = rows.filter("n > 0 and doc_id is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.max("n").alias("n"), F.any_value("hist").alias("hist"))
    sets = common.written(sets.select("sig", "first.*", "n", "hist"), "sets")

    shared = shared_prefixes(common.written(prefixes(rows), "prefixes"), rule)
    stars = shared.filter("sig <> p_sig").filter(passes(rule, "n", "place", "p_n", "p_place"))
    stars = common.written(stars.select(F.least("sig", "p_sig").alias("u"), F.greatest("sig", "p_sig").alias("v")).distinct(), "stars")
    links = linked(stars, named, sets, rule)
    found = common.written(components(links.union(several(rows)) if by_id else links), "components")
    open_ = common.written(crossing(shared, found, stars, rule), "crossing")
    whole = found
    if not open_.isEmpty():
        more = linked(open_, named, sets, rule)
        whole = common.written(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)), "components")

    members = common.written(sets.select("sig", "doc_id", "mark").join(whole.withColumnRenamed("node", "sig"), "sig"), "members")
    tops = common.written(members.groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("top")), "tops")
    return rows, sets, common.written(members.join(tops, "component").select("sig", F.col("top.doc_id").alias("top_doc"), F.col("top.mark").alias("top_mark")), "groups")


def _with_top(rows: DataFrame, sets: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with the first document of its group."""
    first = common.written(sets.join(groups, "sig", "left").select("sig", F.coalesce("top_doc", "doc_id").alias("top_doc"), F.coalesce("top_mark", "mark").alias("top_mark")), "first")
    return rows.select("doc_id", "mark", "n", "sig").join(first, "sig", "left")


def classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id: a row a row of docs."""
    joined = _with_top(*grouped(marked(docs.select("doc_id", "text")), rule, True))
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("top_doc"))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def representatives(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of docs, all columns, that are the first of their group: of smallest doc_id, then smallest hash of the text.

    Rows are documents of their own, even where they share a doc_id: two unlike texts of one id both stay. Of rows with equal
    doc_id and text the one whose columns have the smallest hash stays. Rows with a null doc_id stay. What goes is a skinny
    list of hashes; of the texts, only those that a filter of fixed size can't clear move to meet it.
    """
    names, key, again = docs.columns, common.unused(docs, "_mark"), common.unused(docs, "_again")
    same = common.unused(docs, "_same")
    joined = common.written(_with_top(*grouped(marked(docs.select("doc_id", "text")), rule, False)).filter("doc_id is not null and n > 0"), "classes")
    marks = joined.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("k"), F.bool_and((F.col("top_doc") == F.col("doc_id")) & (F.col("top_mark") == F.col("mark"))).alias("stays"))
    listed = common.written(marks.filter("k > 1 or not stays").select(F.col("doc_id").alias(same), F.col("mark").alias(key), F.col("stays").alias(again)), "listed")
    doubtful, clear = idfilter.divided(marked(docs, key), listed, key, key)
    met = doubtful.withColumn(same, F.col("doc_id").cast("long")).join(listed, [key, same], "left")
    kinds = [c for c in names if "map<" not in dict(docs.dtypes)[c]]
    repeated = met.filter(F.col(again)).groupBy(key).agg(F.min_by(F.struct(*names), F.xxhash64(*kinds)).alias(again)).select(f"{again}.*")
    return clear.select(*names).unionByName(met.filter(F.col(again).isNull()).select(*names)).unionByName(repeated)
