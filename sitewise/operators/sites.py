"""From alignments to alleles: site explosion, counts, filters, one-hot features.

Tables: alignments (gene, sample, seq), sites (gene, sample, pos, ch) with 0-based
pos, counts (gene, pos, ch, n), features (gene, pos, allele, n, total, major).

A site is never gathered before it is counted: counts are pre-aggregated per
task, and only (gene, pos, ch) rows shuffle. Per-site statistics need the few
alleles of a site together, never its samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import GAPS, MINOR_POS, label
from ..sources.scratch import beside, settled


def explode_sites(alignments: DataFrame) -> DataFrame:
    """One row per character; extra columns (such as y) ride along."""
    keep = [c for c in alignments.columns if c != "seq"]
    return alignments.select(*keep, F.posexplode(F.split("seq", "")).alias("pos", "ch"))


def ungapped(sites: DataFrame, skip_x: bool = False, gaps: tuple[str, ...] = GAPS) -> DataFrame:
    """Drops the characters that are no allele."""
    return sites.where(~F.col("ch").isin(*gaps, *(("X",) if skip_x else ())))


def last_of_each(alignments: DataFrame, order: str = "seq_ord") -> DataFrame:
    """Of sequences with the same gene and sample the last one."""
    row = F.row_number().over(Window.partitionBy("gene", "sample").orderBy(F.desc(order)))
    return alignments.withColumn("_row", row).where("_row = 1").drop("_row")


def one_of_each(alignments: DataFrame) -> DataFrame:
    """The last sequence of each gene and sample (without ``seq_ord``, the greatest). Repeats are looked for in the
    keys alone; only if there are some do sequences shuffle."""
    if alignments.groupBy("gene", "sample").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        return alignments
    return last_of_each(alignments, "seq_ord" if "seq_ord" in alignments.columns else "seq")


def with_hypothesis(alignments: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """Alignments of the samples with a non-zero response, with y."""
    return alignments.join(hypothesis.where("y <> 0").select("sample", "y"), "sample")


def missing_sequences(alignments: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """(gene, sample): samples of the hypothesis without a sequence in a gene."""
    cohort = hypothesis.where("y <> 0").agg(F.array_sort(F.collect_set("sample")).alias("_all"))  # the cohort: one row
    own = alignments.join(hypothesis.where("y <> 0").select("sample").distinct(), "sample", "left_semi").groupBy("gene").agg(F.collect_set("sample").alias("_own"))
    held = alignments.select("gene").distinct().join(own, "gene", "left").crossJoin(cohort)  # a row per gene
    return held.select("gene", F.explode(F.when(F.col("_own").isNull(), F.col("_all")).otherwise(F.array_except("_all", "_own"))).alias("sample"))


def allele_counts(sites: DataFrame) -> DataFrame:
    return sites.groupBy("gene", "pos", "ch").agg(F.count(F.lit(1)).alias("n"))


#: Characters of a slice that :func:`slice_counts` counts at a time, those that it holds of all slices, and rows of a batch that it emits.
SLICE_CHARS, HELD_CHARS, BATCH_ROWS = 4 << 20, 16 << 20, 65_536


def counted(alignments: DataFrame, gaps: tuple[str, ...] = GAPS) -> DataFrame:
    """(gene, pos, ch, n) of whole sequences without gaps: what :func:`allele_counts` of exploded sites gives, with no row per character."""
    return slice_counts(alignments.select("gene", "seq"), gaps).groupBy("gene", "pos", "ch").agg(F.sum("n").alias("n"))


def slice_counts(alignments: DataFrame, gaps: tuple[str, ...] = GAPS) -> DataFrame:
    """(gene, pos, ch, n) of slices of the sequences, which the caller sums; further long columns of ``alignments`` stand between gene and
    pos and are counted by."""
    by = [c for c in alignments.columns if c not in ("gene", "seq")]
    return _sliced(alignments.select("gene", *by, "seq"), by, [], gaps)


def class_counts(alignments: DataFrame, classes: int, gaps: tuple[str, ...] = GAPS) -> DataFrame:
    """(gene, pos, ch, n0, n1, ...): what :func:`counted` gives, by the column ``class`` of (gene, class, seq), a long from 0 to below
    ``classes`` (4096 at most). A row of a slice has all classes of its allele, so that their number does not multiply the rows."""
    if not 0 < classes <= 4096:
        raise ValueError("classes are 1 to 4096")
    names = [f"n{k}" for k in range(classes)]
    return _sliced(alignments.select("gene", "class", "seq"), [], names, gaps).groupBy("gene", "pos", "ch").agg(*[F.sum(n).alias(n) for n in names])


def _sliced(alignments: DataFrame, by: list[str], classes: list[str], gaps: tuple[str, ...]) -> DataFrame:
    """Counts of slices by (gene, ``by``), in a column per class if there are some: the column before seq is the class then."""
    left_out = np.array([ord(g) for g in gaps], np.uint32)
    counts = classes or ["n"]
    shift = np.uint64((len(counts) - 1).bit_length())
    schema = pa.schema([("gene", pa.string()), *[(c, pa.int64()) for c in by], ("pos", pa.int32()), ("ch", pa.string()), *[(c, pa.int64()) for c in counts]])

    def sums(key: tuple, texts: list[str], kinds: list[int]) -> Iterator[pa.RecordBatch]:
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        pos = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        cells = (pos.astype(np.uint64) << np.uint64(21) | codes) << shift
        if classes:
            cells |= np.repeat(np.array(kinds, np.uint64), lengths)
        cells = cells[~np.isin(codes, left_out)]
        del codes, pos
        cells.sort()
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.empty(0, np.int64)
        n, cells = np.diff(np.append(first, len(cells))), cells[first]
        sites, kind = cells >> shift, (cells & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], sites[1:] != sites[:-1]])) if len(sites) else first
        ends = np.append(begin, len(sites))
        sites = sites[begin]
        pos, codes = (sites >> np.uint64(21)).astype(np.int32), (sites & np.uint64((1 << 21) - 1)).astype(np.uint32)
        names, ch = np.unique(codes, return_inverse=True)
        names = pa.array([chr(k) for k in names.tolist()], pa.string())
        for at in range(0, len(sites), BATCH_ROWS):
            m = len(sites[at : at + BATCH_ROWS])
            some = slice(ends[at], ends[at + m])
            table = np.zeros((len(counts), m), np.int64)
            table[kind[some], np.repeat(np.arange(m), np.diff(ends[at : at + m + 1]))] = n[some]
            fixed = [pa.array([v], f.type).take(pa.array(np.zeros(m, np.int32))) for v, f in zip(key, schema, strict=False)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(pos[at : at + m]), names.take(pa.array(ch[at : at + m])), *[pa.array(c) for c in table]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list[str], list[int], list[int]]] = {}
        size = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            kinds = columns.pop() if classes else [0] * batch.num_rows
            for *key, kind, text in zip(*columns, kinds, batch.column(batch.num_columns - 1), strict=True):
                if not text.is_valid:
                    continue
                text = text.as_py().decode("utf-8", "replace")
                texts, own, chars = held.setdefault(tuple(key), ([], [], [0]))
                texts.append(text)
                own.append(kind)
                chars[0] += len(text)
                size += len(text)
                if chars[0] < SLICE_CHARS and size < HELD_CHARS:
                    continue
                key = max(held, key=lambda k: held[k][2][0])  # the longest, so that slices stay long where there are several genes
                texts, own, chars = held.pop(key)
                size -= chars[0]
                yield from sums(key, texts, own)
        for key, (texts, own, _) in held.items():
            yield from sums(key, texts, own)

    rows = alignments.withColumn("seq", F.col("seq").cast("binary"))
    ddl = ", ".join(["gene string", *[f"`{c}` long" for c in by], "pos int, ch string", *[f"`{c}` long" for c in counts]])
    return rows.mapInArrow(run, ddl)


def major_of() -> Column:
    """Aggregate: the commonest allele, the lowest character of several."""
    return F.max_by("ch", F.struct(F.col("n"), -F.ascii("ch")))


def site_stats(counts: DataFrame, *by: str) -> DataFrame:
    """Per site (of each ``by``): major, n_major, total (of ungapped samples), minor (all but the major), alleles."""
    return counts.groupBy(*by, "gene", "pos").agg(
        major_of().alias("major"), F.max("n").alias("n_major"), F.sum("n").cast("long").alias("total"),
        (F.sum("n") - F.max("n")).cast("long").alias("minor"), F.count(F.lit(1)).alias("alleles"))


def variable_sites(stats: DataFrame) -> DataFrame:
    """Sites that are neither all singletons nor one allele with at most one other sample; as in paired contrasts."""
    return stats.where((F.col("alleles") >= 2) & (F.col("alleles") != F.col("total")) & (F.col("n_major") != F.col("total") - 1))


def features(counts: DataFrame, min_minor: int = 2, drop_major: bool = False, dropout: DataFrame | None = None) -> DataFrame:
    """One-hot columns: alleles of polymorphic sites, with enough minor alleles and enough samples of their own.

    ``dropout``: a table with ``label``, left out.
    """
    alleles = F.collect_list(F.struct("ch", "n"))  # at most an alphabet per site
    sites = counts.groupBy("gene", "pos").agg(
        alleles.alias("_alleles"), major_of().alias("major"), F.max("n").alias("_most"), F.sum("n").cast("long").alias("total"), F.count(F.lit(1)).alias("_kinds"))
    sites = sites.where((F.col("_kinds") >= 2) & (F.col("total") - F.col("_most") >= min_minor))
    out = sites.select("gene", "pos", "major", "total", F.explode("_alleles").alias("a")).select("gene", "pos", F.col("a.ch").alias("allele"), F.col("a.n").alias("n"), "total", "major")
    out = out.where(F.col("n") >= min_minor)
    if drop_major:
        out = out.where(F.col("allele") != F.col("major"))
    if dropout is not None:
        out = out.join(dropout.select("label").distinct(), label(F.col("gene"), F.col("pos"), F.col("allele")) == F.col("label"), "left_anti")
    return out


def paired_features(counts: DataFrame, min_minor: int = 2, *by: str) -> DataFrame:
    """Columns of paired contrasts: of variable sites with at least ``min_minor`` minor alleles."""
    stats = variable_sites(site_stats(counts, *by)).where(F.col("minor") >= min_minor)
    return counts.join(stats.select(*by, "gene", "pos", "major", "total"), [*by, "gene", "pos"]).where(F.col("n") >= min_minor).select(*by, "gene", "pos", F.col("ch").alias("allele"), "n", "total", "major")


def gene_sizes(feats: DataFrame) -> DataFrame:
    """Columns per gene."""
    return feats.groupBy("gene").agg(F.count(F.lit(1)).alias("n_columns"))


def feature_index(feats: DataFrame) -> DataFrame:
    """Features with col_id: 0, 1, ... by gene, pos and character.

    Numbers within (gene, pos), where a site's few alleles meet, plus offsets from
    sums per site and gene; no window sees all features.
    """
    site = feats.groupBy("gene", "pos").agg(F.count(F.lit(1)).alias("_k"))
    gene = site.groupBy("gene").agg(F.sum("_k").alias("_total"))
    start = F.coalesce(F.sum("_total").over(Window.orderBy("gene").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = gene.select("gene", start.alias("_start"))  # a row per gene
    block = F.floor(F.col("pos") / 4096)
    blocks = site.groupBy("gene", block.alias("_block")).agg(F.sum("_k").alias("_b"))
    before = F.coalesce(F.sum("_b").over(Window.partitionBy("gene").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("gene", "_block", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("gene", "_block").orderBy("pos", F.ascii("allele"), "allele")) - 1
    out = feats.withColumn("_block", block).withColumn("_place", place)
    out = out.join(blocks, ["gene", "_block"]).join(starts, "gene")
    return out.withColumn("col_id", (F.col("_start") + F.col("_before") + F.col("_place")).cast("long")).drop("_start", "_before", "_place", "_block")


def group_ranges(sizes: DataFrame) -> DataFrame:
    """1-based inclusive first and last column of each gene, in order of name (a row per gene)."""
    order = Window.orderBy("gene")
    last = F.sum("n_columns").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return sizes.select("gene", "n_columns", (last - F.col("n_columns") + 1).cast("long").alias("first_col"), last.cast("long").alias("last_col"))


def cells(sites: DataFrame, indexed: DataFrame) -> DataFrame:
    """Non-zero cells of the one-hot matrix: (col_id, sample)."""
    return sites.join(beside(indexed.select("gene", "pos", F.col("allele").alias("ch"), "col_id"), "columns"), ["gene", "pos", "ch"]).select("col_id", "sample")


def minor_column(sites: DataFrame, feats: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """(gene, sample, minor): 1 if the sample has a non-major encoded allele in the gene; genes with such an allele only.
    ``present``: the (gene, sample) pairs, if they are known from something shorter than the sites."""
    minor = feats.where("allele <> major").select("gene", "pos", F.col("allele").alias("ch"), F.lit(1).alias("hit"))
    every = (sites if present is None else present).select("gene", "sample").distinct().join(minor.select("gene").distinct(), "gene", "left_semi")
    hits = sites.join(minor, ["gene", "pos", "ch"]).groupBy("gene", "sample").agg(F.max("hit").alias("hit"))
    return every.join(hits, ["gene", "sample"], "left").select("gene", "sample", F.coalesce("hit", F.lit(0)).alias("minor"))


#: Positions of a piece, and rows of blocks (a string per position each) that are broadcast.
PIECE, PIECES_BESIDE = 1024, 2000


def minor_column_of(alignments: DataFrame, feats: DataFrame, width: int = PIECE) -> DataFrame:
    """As :func:`minor_column`, from whole sequences: pieces of ``width`` characters meet the minor alleles of their positions, so that
    neither characters nor, where the blocks of alleles are few, sequences are shuffled."""
    feats = settled(feats.where("allele <> major").select("gene", "pos", "allele"), "minor")
    block, at = F.floor(F.col("pos") / width).cast("int"), F.pmod("pos", F.lit(width)).cast("int")
    sites = feats.groupBy("gene", block.alias("block"), at.alias("at")).agg(F.array_join(F.collect_list("allele"), "").alias("minor"))  # at most an alphabet
    known = sites.groupBy("gene", "block").agg(F.map_from_entries(F.collect_list(F.struct("at", "minor"))).alias("m"))  # at most ``width``
    blocks = beside(known.select("gene", "block", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))).alias("minor")), "minor-blocks", PIECES_BESIDE)
    pieces = alignments.where(F.length("seq") > 0).select("gene", "sample", "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / width).cast("int"))).alias("block"))
    pieces = pieces.select("gene", "sample", "block", F.split(F.expr(f"substring(seq, block * {width} + 1, {width})"), "").alias("chars"))
    places = F.sequence(F.lit(0), F.size("chars") - 1)
    hit = F.exists(places, lambda i: F.call_function("instr", F.get("minor", i), F.get("chars", i)) > 0)
    hits = pieces.join(blocks, ["gene", "block"]).select("gene", "sample", hit.alias("hit")).where("hit").select("gene", "sample").distinct().withColumn("minor", F.lit(1))
    present = alignments.where(F.length(F.translate("seq", "".join(GAPS), "")) > 0).select("gene", "sample").distinct()
    every = present.join(beside(feats.select("gene").distinct(), "minor-genes"), "gene", "left_semi")
    return every.join(hits, ["gene", "sample"], "left").select("gene", "sample", F.coalesce("minor", F.lit(0)).alias("minor"))


def minor_features(feats: DataFrame, tiered: bool = False) -> DataFrame:
    """Columns (gene, pos, allele) of a gene's minor alleles: one for any (``minor``), or one per frequency tier that has some."""
    minor = feats.where("allele <> major")
    if not tiered:
        return minor.select("gene").distinct().select("gene", F.lit(MINOR_POS).alias("pos"), F.lit("minor").alias("allele"))
    met = minor.select("gene", _frequency().alias("freq")).groupBy("gene").agg(F.max("freq").alias("freq")).join(_tiers(feats), F.col("freq") > F.col("bound"))
    return met.select("gene", F.lit(MINOR_POS).alias("pos"), F.concat(F.lit("tminor_"), "tier").alias("allele"))


def minor_cells(sites: DataFrame, indexed: DataFrame) -> DataFrame:
    """Non-zero cells (col_id, sample) of the columns of minor alleles among ``indexed``, from one pass over the sites."""
    own = indexed.where(F.col("pos") == MINOR_POS).select("gene", F.col("allele").alias("_name"), "col_id")
    feats = indexed.where(F.col("pos") != MINOR_POS)
    names = [F.struct(F.lit("minor").alias("_name"), F.lit(-1.0).cast("float").alias("_bound")), *[F.struct(F.lit(f"tminor_{tier}").alias("_name"), F.lit(bound).cast("float").alias("_bound")) for tier, bound in TIERS]]
    bounds = sites.sparkSession.range(1).select(F.inline(F.array(*names)))  # five rows
    own = beside(own.join(F.broadcast(bounds), "_name").select("gene", "_bound", "col_id"), "minor-columns")
    return _minor_hits(sites, feats).join(own, "gene").where(F.col("freq") > F.col("_bound")).select("col_id", "sample")


#: Lower bounds of the frequency tiers of minor alleles, and the names of their columns (fixed values).
TIERS = (("0pct", 0.0), ("0.1pct", 0.001), ("1pct", 0.01), ("5pct", 0.05))


def tiered_minor(sites: DataFrame, feats: DataFrame) -> DataFrame:
    """(gene, tier, sample): samples with an encoded minor allele more frequent than the tier's bound."""
    return _minor_hits(sites, feats).join(_tiers(sites), F.col("freq") > F.col("bound")).select("gene", "tier", "sample")


def _minor_hits(sites: DataFrame, feats: DataFrame) -> DataFrame:
    """(gene, sample, freq): the frequency of the commonest encoded minor allele of each sample that has one."""
    minor = beside(feats.where("allele <> major").select("gene", "pos", F.col("allele").alias("ch"), _frequency().alias("freq")), "minor")
    return sites.join(minor, ["gene", "pos", "ch"]).groupBy("gene", "sample").agg(F.max("freq").alias("freq"))


def _tiers(df: DataFrame) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(TIERS, "tier string, bound float"))  # four rows


def _frequency() -> Column:
    return (F.col("n").cast("float") / F.col("total").cast("float")).cast("float")


def gap_cancelled(sites: DataFrame, pairs: DataFrame, partner_only: bool = False, tri_allelic: bool = False, min_pairs: int = 2, outgroup=None, by: tuple[str, ...] = ()) -> DataFrame:
    """Paired contrasts: characters of the paired samples after gap cancellation.

    ``pairs`` (sample, pair, and with an outgroup the boolean control). A site with a
    gap in any pair becomes ``-`` for all paired samples; with ``partner_only`` just
    for that pair, and for all if fewer than ``min_pairs`` whole pairs are left.
    ``tri_allelic``: sites with more than two residues become gaps. ``outgroup``: so
    do sites where a control differs from that sample. Others stay as they are. With ``by``, pairs of several contrasts are
    cancelled side by side, each by its own, and only the paired samples' characters are returned.
    """
    key = [*by, "gene", "pos"]
    gap = F.col("ch").isin(*GAPS)
    met = sites.join(pairs, "sample", "inner" if by else "left")
    paired = F.col("pair").isNotNull()
    per_pair = met.where(paired).groupBy(*key, "pair").agg(F.count_if(gap).alias("_gaps"), F.count_if(~gap).alias("_chars"))
    site = per_pair.groupBy(*key).agg(F.count_if((F.col("_gaps") == 0) & (F.col("_chars") >= 2)).alias("_whole"), F.count_if(F.col("_gaps") > 0).alias("_broken"))
    out = met.join(site, key, "left")
    if partner_only:
        out = out.join(per_pair.select(*key, "pair", "_gaps"), [*key, "pair"], "left")
        lost = (F.col("_gaps") > 0) | (F.col("_whole") < min_pairs)
    else:
        lost = F.col("_broken") > 0
    if tri_allelic:
        kinds = met.where(paired & ~gap).groupBy(*key).agg(F.count_distinct("ch").alias("_kinds"))
        out = out.join(kinds, key, "left")
        lost |= F.coalesce(F.col("_kinds") > 2, F.lit(False))
    if outgroup is not None:
        other = sites.where(F.col("sample") == outgroup).select("gene", "pos", F.col("ch").alias("_out"))
        differs = met.where("control").join(other, ["gene", "pos"]).groupBy(*key).agg(F.bool_or(F.col("ch") != F.col("_out")).alias("_differs"))
        out = out.join(differs, key, "left")
        lost |= F.coalesce("_differs", F.lit(False))
    return out.select(*key, "sample", *(["pair"] if by else []), F.when(paired & lost, F.lit("-")).otherwise(F.col("ch")).alias("ch"))


def with_all(sites: DataFrame, samples: DataFrame) -> DataFrame:
    """Sites of the genes in which every one of ``samples`` has a sequence."""
    wanted = samples.select("sample").distinct()
    n = wanted.agg(F.count(F.lit(1)).alias("_n"))
    whole = sites.join(wanted, "sample").groupBy("gene").agg(F.count_distinct("sample").alias("_k")).join(F.broadcast(n)).where("_k = _n")  # one row
    return sites.join(whole.select("gene"), "gene", "left_semi")
