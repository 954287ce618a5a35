"""Registered queries of the versioned-document engine; each takes (spark, sf_dir)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import scratch
from palimpsest.functions import hashing as H
from palimpsest.operators import cutters as cutter_functions
from palimpsest.operators import covers as greedy_covers
from palimpsest.operators import features, fragments, fusion, grammar, index, kernels, optimise, parts, runs, segments, versioned
from palimpsest.plans.constants import COST_WINDOWS, FIXED_JUMP, MAX_BLOCK, MAX_TOKENS, MAX_VERSION, SWEEP, TREE_JUMP, WINDOWS
from palimpsest.plans.oracle import ORACLE_SQL
from palimpsest.session import with_package
from palimpsest.sources import corpus, layouts, sinks

KEYS = ("collection", "version")
#: Text of a bucket of index runs.
BUCKET_BYTES = 32 << 20
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = with_package(f)
    return f


def content(col="toks"):
    return F.md5(F.array_join(col, " "))


def lengths(arrays: DataFrame) -> DataFrame:
    return arrays.select(*KEYS, F.size("toks").alias("len"))


def winnow_blocks(arrays: DataFrame, w: int) -> DataFrame:
    """Blocks between winnowed boundaries; versions without n-grams are one block."""
    rows = kernels.with_bounds(arrays, (w,), *KEYS)
    return rows.select(*KEYS, F.explode(segments.blocks_between(f"bounds{w}")).alias("b")).select(*KEYS, "b.*")


def winnow_fragments(arrays: DataFrame, w: int = 20) -> DataFrame:
    cut = versioned.fragment_rows(arrays, (w,))
    return cut.withColumn("len", F.col("end") - F.col("start"))


def window_tradeoff(arrays: DataFrame, windows=WINDOWS) -> DataFrame:
    """collection, w, n_apps, n_frags, n_postings of single-level winnowing at several windows, in one pass over the versions."""
    return versioned.tradeoff(versioned.fragment_rows(arrays, windows))


def candidates(arrays: DataFrame, w: int = 20, total: int = 3, sliding_from: int = 1 << 30) -> DataFrame:
    """Candidate fragments of all levels, hashed."""
    # the level chain reads this several times
    base = scratch.table(winnow_blocks(arrays, w), "blocks")
    level_rows = segments.levels(base, total, sliding_from, *KEYS)
    return fragments.cut_tokens(level_rows, arrays, *KEYS)


def covers_of(arrays: DataFrame, weights, by_grammar: bool = False) -> DataFrame:
    """The chosen cover of every version, one row each, stored: its readers are several."""
    return scratch.table(greedy_covers.covers(arrays, weights, by_grammar), "covers")


def _folder(spark, name: str) -> str:
    return f"{scratch.folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def list_digest(id_columns, postings="postings"):
    """MD5 of a posting list as text."""
    return F.md5(F.array_join(F.transform(postings, lambda p: F.concat_ws(":", *id_columns(p), p["pos"])), " "))


# --- sources -----------------------------------------------------------------


@query
def scan_documents(spark, sf_dir):
    return corpus.token_arrays(spark, sf_dir).select("doc_id", F.size("toks").cast("long").alias("n_tokens"), content().alias("content"))


@query
def collections(spark, sf_dir):
    return corpus.versions(spark, sf_dir).select("collection", F.col("version").cast("long").alias("version"), "doc_id", F.size("toks").cast("long").alias("n_tokens"))


@query
def version_counts(spark, sf_dir):
    return corpus.catalog(corpus.versions(spark, sf_dir))


@query
def version_lengths(spark, sf_dir):
    return corpus.conversations(spark, sf_dir).select(*KEYS, F.size("toks").cast("long").alias("n_tokens"))


@query
def catalog_lookup(spark, sf_dir):
    return corpus.catalog(corpus.conversations(spark, sf_dir).where(F.col("collection").isin(0, 7, 11, 99999)))


@query
def posting_decode(spark, sf_dir):
    return corpus.decode_postings(corpus.encode_postings(corpus.conversations(spark, sf_dir), *KEYS), *KEYS).withColumn("pos", F.col("pos").cast("long"))


@query
def vocabulary(spark, sf_dir):
    return corpus.vocabulary(corpus.tokens(corpus.token_arrays(spark, sf_dir), "doc_id")).select("term", "freq", F.col("term_id").cast("long"))


@query
def sweep_grid(spark, sf_dir):
    grid = F.explode(F.array(*(F.lit(float(w)) for w in SWEEP))).alias("w")
    return corpus.versions(spark, sf_dir).select("collection").distinct().select("collection", grid)


@query
def prefix_base(spark, sf_dir):
    """Exclusive prefix sums of version counts over all collections."""
    counts = corpus.catalog(corpus.conversations(spark, sf_dir)).withColumnRenamed("n_versions", "n")
    return versioned.prefix_sums(counts, "collection", "n", F.expr("collection div 16777216"), F.expr("collection div 4096"))


@query
def version_base(spark, sf_dir):
    """The first global version number of each collection of documents."""
    counts = corpus.catalog(corpus.versions(spark, sf_dir)).withColumnRenamed("n_versions", "n")
    return versioned.prefix_sums(counts, "collection", "n", *versioned.hex_levels())


@query
def catalog_tsv(spark, sf_dir):
    """The catalogue of conversations, written as tab-separated text and imported again."""
    at = _folder(spark, "catalog")
    sinks.write_catalog_tsv(corpus.catalog(corpus.conversations(spark, sf_dir)), at)
    return corpus.read_catalog_tsv(spark, at).select(F.col("doc_id").alias("collection"), F.col("n_versions").cast("long").alias("n_versions"))


@query
def sweep_list(spark, sf_dir):
    """The parameter list, written as text and read again."""
    at = _folder(spark, "options")
    sinks.write_doubles(spark.createDataFrame([(float(w),) for w in SWEEP], "w double"), at)
    return corpus.read_doubles(spark, at)


@query
def corpus_file(spark, sf_dir):
    """All versions, written in version order and read again."""
    at = _folder(spark, "corpus")
    sinks.write_corpus(corpus.versions(spark, sf_dir), at, *KEYS)
    return sinks.read_corpus(spark, at).select("collection", F.col("version").cast("long").alias("version"), F.col("n_tokens").cast("long").alias("n_tokens"), content().alias("content"))


@query
def feature_file(spark, sf_dir):
    """n-gram hashes and frequencies of every version, written as arrays and read again."""
    at = _folder(spark, "features")
    sinks.write_features(features.frequency_arrays(corpus.versions(spark, sf_dir), *KEYS), at)
    rows = spark.read.parquet(at).where(F.size("freq") > 0)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("collection", F.col("version").cast("long").alias("version"), F.size("freq").cast("long").alias("n"), total("freq").alias("sum_freq"), F.array_max("freq").alias("max_freq"), total("h").alias("sum_h"))


@query
def radius_file(spark, sf_dir):
    """Dominance radii of every version of a conversation, written as arrays and read again."""
    at = _folder(spark, "radii")
    sinks.write_features(features.radius_arrays(kernels.with_grams(corpus.conversations(spark, sf_dir), *KEYS), *KEYS), at)
    return _longs(spark.read.parquet(at).select(*KEYS, F.posexplode("radius").alias("pos", "radius")), *KEYS, "pos", "radius")


# --- filters and whole-corpus figures ------------------------------------------


@query
def filter_range(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").where(F.col("doc_id").between(100, 299)).select("doc_id", "n_chars")


@query
def filter_long_versions(spark, sf_dir):
    rows = corpus.versions(spark, sf_dir).select("collection", F.col("version").cast("long").alias("version"), F.size("toks").cast("long").alias("n_tokens"))
    return rows.where(F.col("n_tokens") > H.NGRAM)


def within_size(spark, sf_dir, most: int) -> DataFrame:
    return doc_sizes(spark, sf_dir).where(F.col("n_tokens") <= most)


def with_anomalies(spark, sf_dir, most: int) -> DataFrame:
    return corpus.versions(spark, sf_dir).groupBy("collection").agg((F.max(F.size("toks")) > most).alias("anomalous"))


@query
def filter_oversize(spark, sf_dir):
    return within_size(spark, sf_dir, 2000)


@query
def filter_oversize_fixed(spark, sf_dir):
    """Collections of at most a million tokens."""
    return within_size(spark, sf_dir, MAX_TOKENS)


@query
def mark_anomalies(spark, sf_dir):
    return with_anomalies(spark, sf_dir, 2000)


@query
def mark_anomalies_fixed(spark, sf_dir):
    """Whether a collection has a version of more than 20,000 tokens."""
    return with_anomalies(spark, sf_dir, MAX_VERSION)


@query
def single_versions(spark, sf_dir):
    one = corpus.versions(spark, sf_dir).groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("toks")).cast("long").alias("n_postings")).where("n = 1")
    return one.select("collection", F.lit(1).alias("n_frags"), F.lit(1).alias("n_apps"), "n_postings")


@query
def equal_versions(spark, sf_dir):
    """Versions that equal another one of their collection: the first of their class, and its size."""
    rows = corpus.versions(spark, sf_dir).select("collection", F.col("version").cast("long").alias("version"), content().alias("c"))
    classes = rows.groupBy("collection", "c").agg(F.min("version").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(classes, ["collection", "c"]).select("collection", "version", "first", "n")


@query
def doc_sizes(spark, sf_dir):
    return corpus.versions(spark, sf_dir).groupBy("collection").agg(F.sum(F.size("toks")).alias("n_tokens"))


@query
def doc_count(spark, sf_dir):
    return corpus.versions(spark, sf_dir).agg(F.count_distinct("collection").alias("n_collections"), F.count(F.lit(1)).alias("n_versions"), F.sum(F.size("toks")).alias("n_postings"))


@query
def sample_docs(spark, sf_dir):
    return optimise.sample(corpus.table(spark, sf_dir, "documents"), "doc_id", 50)


@query
def sampled_sizes(spark, sf_dir):
    chosen = corpus.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return corpus.token_arrays(spark, sf_dir).join(chosen, "doc_id", "left_semi").select("doc_id", F.size("toks").cast("long").alias("n_tokens"))


@query
def unsampled_sizes(spark, sf_dir):
    chosen = corpus.table(spark, sf_dir, "labels").select("doc_id")
    return corpus.token_arrays(spark, sf_dir).join(chosen, "doc_id", "left_anti").select("doc_id", F.size("toks").cast("long").alias("n_tokens"))


# --- hashes and features -------------------------------------------------------


@query
def word_hash(spark, sf_dir):
    terms = corpus.tokens(corpus.token_arrays(spark, sf_dir), "doc_id").select("term").distinct()
    return features.hashed_tokens(terms).select("wid", "b").distinct()


@query
def content_hash(spark, sf_dir):
    rows = corpus.token_arrays(spark, sf_dir).select("doc_id", content().alias("content"))
    return rows.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query
def ngram_hash(spark, sf_dir):
    rows = kernels.with_grams(corpus.versions(spark, sf_dir), *KEYS).where(F.size("h") > 0)
    total = F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("collection", F.col("version").cast("long").alias("version"), F.size("h").cast("long").alias("n"), total.alias("sum_h"), F.array_min("h").alias("min_h"), F.array_max("h").alias("max_h"))


@query
def ngram_hash_positions(spark, sf_dir):
    """The same hashes from token rows, by native columns."""
    rows = features.ngrams(corpus.tokens(corpus.conversations(spark, sf_dir), *KEYS), *KEYS)
    return rows.select(*KEYS, F.col("pos").cast("long").alias("pos"), "h")


def _longs(df, *cols):
    return df.select(*(F.col(c).cast("long").alias(c) if c in ("version", "pos", "idx", "start", "end", "parent", "radius", "length", "offset", "len") else c for c in cols))


@query
def ngram_freq(spark, sf_dir):
    """Every n-gram that repeats in its collection, or stands before a change of frequency."""
    rows = features.frequency_rows(corpus.versions(spark, sf_dir), *KEYS).where("freq > 1 or diff <> 0")
    return _longs(rows, *KEYS, "pos", "freq", "diff")


@query
def ngram_profile(spark, sf_dir):
    """Per collection: n-grams, distinct ones, and the greatest frequency."""
    rows = kernels.with_grams(corpus.versions(spark, sf_dir), *KEYS).select("collection", F.explode("h").alias("h"))
    return rows.groupBy("collection", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("collection").agg(F.sum("n").alias("n_grams"), F.count(F.lit(1)).alias("n_distinct"), F.max("n").alias("max_freq"))


@query
def winnow_boundaries(spark, sf_dir):
    return _longs(features.cuts(corpus.versions(spark, sf_dir), 20, *KEYS), *KEYS, "pos")


@query
def dominance_radius(spark, sf_dir):
    return _longs(features.radii(corpus.conversations(spark, sf_dir), *KEYS), *KEYS, "pos", "radius")


@query
def winnow_parts(spark, sf_dir):
    """Winnowed boundaries of versions that are cut into parts of 64 n-grams."""
    return _longs(parts.winnow_in_parts(corpus.versions(spark, sf_dir), 20, *KEYS, size=64), *KEYS, "pos")


@query
def radius_parts(spark, sf_dir):
    """Dominance radii of versions that are cut into parts of 32 n-grams."""
    rows = parts.radii_in_parts(corpus.conversations(spark, sf_dir), *KEYS, size=32).select(*KEYS, "begin", F.posexplode("radius").alias("i", "radius"))
    return _longs(rows.select(*KEYS, (F.col("begin") + F.col("i")).alias("pos"), "radius"), *KEYS, "pos", "radius")


@query
def varbyte_sizes(spark, sf_dir):
    return corpus.token_arrays(spark, sf_dir).select("doc_id", F.size("toks").cast("long").alias("n")).withColumn("size", H.varbyte_size(F.col("n")))


def _codes(spark, sf_dir, flag_high: bool) -> DataFrame:
    rows = corpus.table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.length("text"), F.lit(0)) * 1000 + F.col("doc_id") % 1000).cast("long").alias("n"))
    coded = rows.withColumn("c", H.varbyte_encode(F.col("n"), flag_high))
    return coded.select("doc_id", "n", F.array_join("c", " ").alias("code"), H.varbyte_decode(F.col("c"), flag_high).alias("back"))


@query
def varbyte_low_flag(spark, sf_dir):
    """Numbers in the code with the flag in the low bit, most significant group first."""
    return _codes(spark, sf_dir, False)


@query
def varbyte_high_flag(spark, sf_dir):
    """Numbers in the code with the flag in the high bit, least significant group first."""
    return _codes(spark, sf_dir, True)


@query
def bit_fields(spark, sf_dir):
    """Token counts, characters and ids mod 2**20 as fields of 20 bits, and read again."""
    rows = corpus.token_arrays(spark, sf_dir).select("doc_id", F.array(F.size("toks").cast("long"), F.col("doc_id") % (1 << 20)).alias("v"))
    return rows.withColumn("bits", H.write_bits(F.col("v"), 20)).select("doc_id", "bits", F.array_join(H.read_bits(F.col("bits"), 20), " ").alias("back"))


# --- segmentation --------------------------------------------------------------


@query
def cut_threshold(spark, sf_dir):
    arrays = corpus.conversations(spark, sf_dir)
    return _longs(segments.threshold_cut(features.radii(arrays, *KEYS), lengths(arrays).where("len > 0"), 5, *KEYS), *KEYS, "pos")


def tree_cut(arrays: DataFrame, jump: int = TREE_JUMP) -> DataFrame:
    return segments.tree_cut(features.frequency_rows(arrays, *KEYS), *KEYS, jump=jump)


@query
def cut_tree(spark, sf_dir):
    return _longs(tree_cut(corpus.versions(spark, sf_dir)), *KEYS, "pos")


@query
def cut_tree_fixed(spark, sf_dir):
    """The tree cut at jumps of 10."""
    return _longs(tree_cut(corpus.versions(spark, sf_dir), FIXED_JUMP), *KEYS, "pos")


def feature_arrays(arrays: DataFrame) -> DataFrame:
    """collection, version, len, freq, radius, both as arrays by position."""
    rows = scratch.table(features.frequency_arrays(arrays, *KEYS), "features")
    return rows.join(features.radius_arrays(rows, *KEYS), [*KEYS]).select(*KEYS, "len", "freq", "radius")


@query
def cut_jump(spark, sf_dir):
    return _longs(segments.jump_cut(feature_arrays(corpus.versions(spark, sf_dir)), threshold=1, max_block=MAX_BLOCK), *KEYS, "pos")


@query
def cut_relative_jump(spark, sf_dir):
    return _longs(segments.jump_cut(feature_arrays(corpus.versions(spark, sf_dir)), threshold=1, relative=True), *KEYS, "pos")


@query
def cutters(spark, sf_dir):
    """How many blocks each of several cutters makes of a version."""
    chosen = {"winnow 20": lambda a: features.cuts(a, 20, *KEYS), "winnow 40": lambda a: features.cuts(a, 40, *KEYS), "tree": tree_cut}
    arrays = scratch.table(corpus.versions(spark, sf_dir).select(*KEYS, "toks"), "versions")  # each cutter reads them
    return _longs(segments.cut_with(chosen, arrays).groupBy("cutter", *KEYS).agg(F.count(F.lit(1)).alias("n")), "cutter", *KEYS, "n")


@query
def cutter_levels(spark, sf_dir):
    """Blocks of a registered cutter and of the levels that it merges, by SQL."""
    call = cutter_functions.register(spark, cutter_functions.Winnow(20, levels=3))
    cutter_functions.features_of(corpus.versions(spark, sf_dir)).createOrReplaceTempView("palimpsest_features")
    return _longs(spark.sql(f"SELECT * FROM {call}(TABLE(palimpsest_features))"), *KEYS, "level", "idx", "start", "end").withColumn("level", F.col("level").cast("long"))


@query
def cutter_index(spark, sf_dir):
    """Fragment ids of the versioned index over the tree cutter, taken by name."""
    arrays = corpus.versions(spark, sf_dir)
    cutter_functions.register(spark, cutter_functions.Tree(TREE_JUMP))
    found = versioned.build(arrays, (), cut=cutter_functions.fragments_of(arrays, f"tree_{TREE_JUMP}"))
    return found.dictionary.select("frag_id", "collection", "hash", F.col("len").cast("long").alias("len"), F.col("size").cast("long").alias("size"))


@query
def overfull_versions(spark, sf_dir):
    """Versions with more than 200 candidate blocks on all levels."""
    # the levels' sizes follow from the boundaries' number; no block leaves its version
    cut = kernels.with_bounds(corpus.versions(spark, sf_dir), (20,), *KEYS)
    rows = cut.select(*KEYS, segments.level_counts(F.size("bounds20"), 3, 1 << 30).alias("n"))
    return _longs(rows.where("n > 200"), *KEYS, "n")


def tree_of(arrays: DataFrame) -> DataFrame:
    return kernels.with_tree(arrays, WINDOWS, *KEYS)


@query
def hierarchy_levels(spark, sf_dir):
    """Blocks of several windows, each level refining the next, with the block that holds them."""
    tree = scratch.table(tree_of(corpus.versions(spark, sf_dir)), "tree")  # each level reads it
    return segments.hierarchy(tree, len(WINDOWS), *KEYS).select("collection", *(F.col(c).cast("long").alias(c) for c in ("version", "level", "idx", "start", "end", "parent")))


@query
def tree_conflicts(spark, sf_dir):
    """Ancestors and descendants of every block of the hierarchy."""
    pairs = segments.tree_pairs(tree_of(corpus.versions(spark, sf_dir)), len(WINDOWS), *KEYS)
    return pairs.select("collection", *(F.col(c).cast("long").alias(c) for c in ("version", "level", "idx", "other_level", "other_idx")))


@query
def level_merge(spark, sf_dir):
    return _longs(segments.merge_level(winnow_blocks(corpus.versions(spark, sf_dir), 20), False, *KEYS), *KEYS, "idx", "start", "end")


@query
def level_merge_skip(spark, sf_dir):
    return _longs(segments.merge_level(winnow_blocks(corpus.versions(spark, sf_dir), 20), True, *KEYS), *KEYS, "idx", "start", "end")


@query
def hierarchy(spark, sf_dir):
    rows = segments.levels(winnow_blocks(corpus.versions(spark, sf_dir), 20), 1, 1 << 30, *KEYS)
    return _longs(segments.contained(rows, *KEYS), *KEYS, "idx", "parent")


@query
def cut_histogram(spark, sf_dir):
    return _longs(segments.cut_lengths(winnow_blocks(corpus.versions(spark, sf_dir), 20), *KEYS), "length", "n")


@query
def compare_cutters(spark, sf_dir):
    """Versions that a window of 20 cuts more often than one of 40."""
    rows = kernels.with_bounds(corpus.versions(spark, sf_dir), (20, 40), *KEYS).select(*KEYS, F.size("bounds20").alias("n_first"), F.size("bounds40").alias("n_second"))
    return _longs(rows.where("n_first > n_second"), *KEYS, "n_first", "n_second")


@query
def repair_candidates(spark, sf_dir):
    """Per version, the tokens that leaves and finest nodes of its collection's grammar hold, and nodes that hold none or reach outside."""
    return grammar.repair_checks(grammar.repair_arrays(grammar.stored_texts(corpus.versions(spark, sf_dir)), down=8))


@query
def repair_dictionary(spark, sf_dir):
    """The fragments of all levels of the collections' grammars, with how often each occurs."""
    arrays = corpus.versions(spark, sf_dir).withColumn("version", F.col("version").cast("long"))
    return _longs(greedy_covers.grammar_dictionary(arrays), "collection", "hash", "len", "size")


@query
def cover_grammar_choice(spark, sf_dir):
    """The fragments of the greedy cover of grammar nodes, in the order in which they were chosen."""
    arrays = corpus.versions(spark, sf_dir).withColumn("version", F.col("version").cast("long"))
    return _longs(greedy_covers.products(arrays, [1.0], True), "collection", "rank", "hash", "len", "size", "version", "offset", "faults")


# --- fragments -------------------------------------------------------------------


@query
def fragment_dict(spark, sf_dir):
    return _longs(fragments.dictionary(winnow_fragments(corpus.versions(spark, sf_dir))), "collection", "hash", "len", "size")


@query
def fragment_dict_levels(spark, sf_dir):
    """The dictionary of candidate blocks of four levels."""
    return _longs(fragments.dictionary(candidates(corpus.versions(spark, sf_dir))), "collection", "hash", "len", "size")


@query
def fragment_scores(spark, sf_dir):
    rows = fragments.dictionary(winnow_fragments(corpus.versions(spark, sf_dir)))
    n, size, w = F.col("len").cast("double"), F.col("size").cast("double"), F.lit(10.0)
    return rows.select("collection", "hash", F.round(fragments.score(n, size, w), 6).alias("score"), F.round(fragments.grammar_score(n, size, w), 6).alias("grammar_score"))


@query
def overlap_pairs(spark, sf_dir):
    """Pairs of blocks of two levels that overlap."""
    base = winnow_blocks(corpus.versions(spark, sf_dir), 20)
    both = base.select(*KEYS, (F.col("idx") * 2).alias("id"), "start", "end").unionByName(segments.merge_level(base, False, *KEYS).select(*KEYS, (F.col("idx") * 2 + 1).alias("id"), "start", "end"))
    rows = fragments.overlaps(both, *KEYS)
    return rows.select("collection", *(F.col(c).cast("long").alias(c) for c in ("version", "a", "b")))


@query
def select_cover(spark, sf_dir):
    """The fragments of the greedy cover of multi-level candidates, in the order in which they were chosen."""
    arrays = corpus.versions(spark, sf_dir).withColumn("version", F.col("version").cast("long"))
    return _longs(greedy_covers.products(arrays, [1.0]), "collection", "rank", "hash", "len", "size", "version", "offset", "faults")


@query
def select_cover_totals(spark, sf_dir):
    """Applications, fragments, postings and tokens of the greedy cover of each collection."""
    arrays = corpus.versions(spark, sf_dir).withColumn("version", F.col("version").cast("long"))
    return _longs(greedy_covers.totals(greedy_covers.covers(arrays, [1.0])), "collection", "n_apps", "n_frags", "n_postings", "covered", "faults")


@query
def select_cover_grammar(spark, sf_dir):
    """The greedy cover of grammar nodes, checked token by token."""
    arrays = corpus.versions(spark, sf_dir).withColumn("version", F.col("version").cast("long"))
    return greedy_covers.checked(greedy_covers.covers(arrays, [1.0], True)).select("collection", "w", "version", F.col("covered").alias("held"), "faults")


@query
def round_trip(spark, sf_dir):
    """Versions rebuilt from the postings and applications of the chosen cover."""
    arrays = corpus.versions(spark, sf_dir).withColumn("version", F.col("version").cast("long"))
    return greedy_covers.restored(covers_of(arrays, [1.0])).select("collection", "version", F.md5("text").alias("content"))


@query
def first_postings(spark, sf_dir):
    rows = fragments.dictionary(winnow_fragments(corpus.versions(spark, sf_dir)))
    return _longs(rows.select("collection", "hash", "len", "first.version", "first.offset"), "collection", "hash", "len", "version", "offset")


@query
def version_fragments(spark, sf_dir):
    rows = winnow_fragments(corpus.versions(spark, sf_dir)).select("collection", F.col("version").cast("long").alias("version"), "hash").distinct()
    return rows.groupBy("collection", "version").agg(F.md5(F.array_join(F.array_sort(F.collect_list("hash")), " ")).alias("fragments"), F.count(F.lit(1)).alias("n"))


@query
def mergeable_fragments(spark, sf_dir):
    cut = winnow_fragments(corpus.versions(spark, sf_dir))
    return fragments.mergeable(cut.select("collection", F.col("hash").alias("id"), "version", F.col("start").alias("offset"), "len"))


@query
def fused_groups(spark, sf_dir):
    """Chains of fragments that stand side by side wherever they stand."""
    # chains need no numbers of versions, only which texts differ
    texts = corpus.collection_texts(spark, sf_dir).select("collection", F.md5("text").alias("version"), "text", F.size(corpus.joined_tokens()).alias("n"))
    return fusion.window_groups(scratch.table(texts, "texts"), 20)


def fused_of(spark, sf_dir) -> versioned.VersionedIndex:
    """The versioned index after fusing."""
    texts = scratch.table(corpus.collection_texts(spark, sf_dir).select("collection", "doc_id", "text", F.size(corpus.joined_tokens()).alias("n")), "texts")
    # numbering deals versions to their collections, in order
    order = Window.partitionBy("collection").orderBy("doc_id")
    numbered = (rows if rows is None else rows.select("collection", (F.row_number().over(order) - 1).cast("long").alias("version"), "text", "n") for rows in grammar.by_size(texts, fusion.GROUP_TOKENS))
    found = fusion.build(*numbered, WINDOWS)
    scratch.drop(texts)
    return found


@query
def fused_ids(spark, sf_dir):
    """The dictionary of the versioned index after fusing."""
    return fused_of(spark, sf_dir).dictionary.select("frag_id", "collection", "hash", F.col("len").cast("long").alias("len"), F.col("size").cast("long").alias("size"))


@query
def fused_round_trip(spark, sf_dir):
    """Versions rebuilt from the fused index alone."""
    return versioned.restored_texts(fused_of(spark, sf_dir)).select("collection", "version", F.md5("text").alias("content"))


# --- optimisation ------------------------------------------------------------------


@query
def tradeoff_windows(spark, sf_dir):
    return window_tradeoff(corpus.versions(spark, sf_dir))


@query
def sweep_tradeoff(spark, sf_dir):
    """The trade-off of each of the sweep's 20 weights: applications, fragments and postings of the cover of each collection."""
    arrays = corpus.versions(spark, sf_dir).withColumn("version", F.col("version").cast("long"))
    return greedy_covers.totals(greedy_covers.covers(arrays, SWEEP)).select("collection", "w", *(F.col(c).cast("long").alias(c) for c in ("n_apps", "n_frags", "n_postings", "covered", "faults")))


@query
def best_window(spark, sf_dir):
    return optimise.best_by_cost(window_tradeoff(corpus.versions(spark, sf_dir)))


@query
def best_window_fixed(spark, sf_dir):
    """The best of the windows 20, 30 and 40."""
    return optimise.best_by_cost(window_tradeoff(corpus.versions(spark, sf_dir), COST_WINDOWS))


@query
def pareto_frontier(spark, sf_dir):
    return optimise.frontier(window_tradeoff(corpus.versions(spark, sf_dir)))


@query
def unchanged_collections(spark, sf_dir):
    return optimise.unchanged(window_tradeoff(corpus.versions(spark, sf_dir)))


@query
def valid_steps(spark, sf_dir):
    rows = optimise.steps(window_tradeoff(corpus.versions(spark, sf_dir)))
    return rows.select("collection", "w_from", "w_to", (F.col("apps_to") - F.col("apps_from")).alias("apps"), (F.col("post_from") - F.col("post_to")).alias("saved"))


@query
def compare_methods(spark, sf_dir):
    rows = window_tradeoff(corpus.versions(spark, sf_dir))
    a = rows.where("w = 40").select("collection", F.col("n_apps").alias("first_apps"))
    return a.join(rows.where("w = 5").select("collection", F.col("n_apps").alias("second_apps")), "collection").where("first_apps < second_apps")


@query
def reduction(spark, sf_dir):
    arrays = corpus.versions(spark, sf_dir)
    total = arrays.groupBy("collection").agg(F.sum(F.size("toks")).alias("total"))
    rows = window_tradeoff(arrays).join(total, "collection").groupBy("w").agg(F.sum("n_postings").alias("after"), F.sum("total").alias("before"))
    return rows.withColumn("ratio", F.round(F.col("after") / F.col("before"), 6))


@query
def chosen_or_default(spark, sf_dir):
    arrays = corpus.versions(spark, sf_dir)
    chosen = window_tradeoff(arrays).where("n_apps > 3").groupBy("collection").agg(F.min("w").alias("w"))
    return optimise.with_chosen(arrays.select("collection", F.lit(0.0).alias("w")).distinct(), chosen).select("collection", "w")


def _frontier(spark, sf_dir):
    """(frontier rows, 1.5 times the least number of applications)."""
    rows = scratch.table(optimise.frontier(window_tradeoff(corpus.versions(spark, sf_dir))), "frontier")
    least = rows.groupBy("collection").agg(F.min("n_apps").alias("m")).agg(F.sum("m")).first()[0] or 0
    return rows, int(least * 1.5)


@query
def budget_choice(spark, sf_dir):
    """One window per collection under a budget of 1.5 times the least number of applications, by single steps."""
    return optimise.spend(*_frontier(spark, sf_dir))


@query
def budget_jumps(spark, sf_dir):
    """The same with jumps over several rows."""
    rows, budget = _frontier(spark, sf_dir)
    return optimise.spend(rows, budget, jumps=True)


@query
def chosen_totals(spark, sf_dir):
    """What the best windows cost in all."""
    rows = scratch.table(window_tradeoff(corpus.versions(spark, sf_dir)), "tradeoff")
    own = rows.join(optimise.best_by_cost(rows).select("collection", "w"), ["collection", "w"])
    return own.agg(*(F.sum(c).cast("long").alias(c) for c in ("n_apps", "n_frags", "n_postings")))


@query
def compare_frontiers(spark, sf_dir):
    """Collections whose least number of applications by winnowing is below that by the tree cut."""
    arrays = corpus.versions(spark, sf_dir)
    least = window_tradeoff(arrays).groupBy("collection").agg(F.min("n_apps").alias("winnow_apps"))
    blocks = segments.blocks(tree_cut(arrays), lengths(arrays), *KEYS)
    other = blocks.groupBy("collection").agg(F.count(F.lit(1)).alias("tree_apps"))
    return least.join(other, "collection").where("winnow_apps < tree_apps").select("collection", "winnow_apps", "tree_apps")


# --- indexes ------------------------------------------------------------------------


def document_index(spark, sf_dir) -> DataFrame:
    return index.build_arrays(corpus.token_arrays(spark, sf_dir))


@query
def inverted_index(spark, sf_dir):
    """The positional index of all documents, in blocks; lists as text digests."""
    return document_index(spark, sf_dir).select("term", "block", "freq", "n_docs", list_digest(lambda p: [p["docid"]]).alias("postings"))


@query
def lexicon(spark, sf_dir):
    return index.lexicon(document_index(spark, sf_dir))


@query
def index_file(spark, sf_dir):
    """The index written in order of terms, opened and read back to documents."""
    at = _folder(spark, "index")
    index.write_arrays(corpus.token_arrays(spark, sf_dir), at)
    return index.documents(index.open_index(spark, at)).select(F.col("docid").alias("doc_id"), content().alias("content"))


@query
def index_lists(spark, sf_dir):
    """The per-version index of all versions, in blocks of global version numbers; lists as text digests."""
    arrays = corpus.versions(spark, sf_dir).withColumn("version", F.col("version").cast("long"))
    bases = version_base(spark, sf_dir).select("collection", "base")
    rows = index.term_rows(arrays, *KEYS).join(bases, "collection").withColumn("doc", F.struct(*KEYS))
    lists = index.build(rows, "doc", index.block_of(F.col("base") + F.col("version")))
    return lists.select("term", "block", F.col("freq").cast("long").alias("freq"), list_digest(lambda p: [p["docid"]["collection"], p["docid"]["version"]]).alias("postings"))


@query
def index_merge(spark, sf_dir):
    """Three indexes of disjoint documents as sorted runs, merged bucket by bucket."""
    return merged_runs(spark, sf_dir, 3, None).select("term", "block", "freq", "n_docs", list_digest(lambda p: [p["docid"]]).alias("postings"))


def merged_runs(spark, sf_dir, n: int, fanout: int | None) -> DataFrame:
    """The index of all documents from n runs, compacted after each one if a fan-out is told."""
    # buckets grow with the corpus, so that a bucket is a bounded task
    size = corpus.table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    held = runs.Runs(spark, _folder(spark, "runs"), max(8, spark.sparkContext.defaultParallelism, size // BUCKET_BYTES))
    for k in range(n):
        # a run reads the texts of its own documents only
        own = corpus.token_arrays(spark, sf_dir).where(F.col("doc_id") % n == k)
        held.append(index.build_arrays(own, parts=held.buckets), f"run{k}", dealt=True)
        if fanout:
            held.compact(fanout)
    return held.read()


@query
def index_compaction(spark, sf_dir):
    """Five runs, merged by levels of two while they are appended."""
    return merged_runs(spark, sf_dir, 5, 2).select("term", "block", "freq", "n_docs", list_digest(lambda p: [p["docid"]]).alias("postings"))


@query
def forward_restore(spark, sf_dir):
    return index.documents(document_index(spark, sf_dir)).select(F.col("docid").alias("doc_id"), content().alias("content"))


@query
def lookup_all_terms(spark, sf_dir):
    return index.all_terms(document_index(spark, sf_dir), ["the", "of", "and"]).select(F.col("docid").alias("doc_id"))


@query
def lookup_phrase(spark, sf_dir):
    rows = index.phrase(index.read(document_index(spark, sf_dir)), ["of", "the"], "docid")
    return rows.select(F.col("docid").alias("doc_id"), F.col("pos").cast("long").alias("pos"))


def copies_of(arrays: DataFrame) -> DataFrame:
    at = Window.partitionBy("collection").orderBy("version")
    texts = arrays.select(*KEYS, F.array_join("toks", " ").alias("text")).withColumn("before", F.lag("text").over(at)).where("before is not null")
    pairs = texts.select(*KEYS, F.split("text", " ").alias("toks"), F.split("before", " ").alias("reference"))
    found = kernels.with_copies(pairs, 5, *KEYS).select(*KEYS, F.explode("copies").alias("c")).select(*KEYS, "c.*")
    return found.select("collection", *(F.col(c).cast("long").alias(c) for c in ("version", "rstart", "vstart", "len")))


@query
def copy_ranges(spark, sf_dir):
    """What each version copies from the version before it, runs of at least 5 tokens."""
    return copies_of(corpus.versions(spark, sf_dir))


@query
def copy_index(spark, sf_dir):
    """The same ranges as an index that is appended to twice and restored."""
    at, rows = _folder(spark, "copies"), scratch.table(copies_of(corpus.versions(spark, sf_dir)), "ranges")
    for half in range(2):
        sinks.append_copies(rows.where(F.col("version") % 2 == half), at)
    return sinks.restore_copies(spark, at)


# --- the versioned index --------------------------------------------------------------


def versioned_of(spark, sf_dir) -> versioned.VersionedIndex:
    return versioned.build(corpus.versions(spark, sf_dir).withColumn("version", F.col("version").cast("long")), WINDOWS)


@query
def versioned_index(spark, sf_dir):
    """Postings of each distinct fragment at its collection's best window, once, by global fragment id, in blocks."""
    return versioned_of(spark, sf_dir).postings.select("term", "block", "freq", "n_docs", list_digest(lambda p: [p["docid"]]).alias("postings"))


@query
def fragment_ids(spark, sf_dir):
    """Global fragment ids, and how often each fragment is applied."""
    return versioned_of(spark, sf_dir).dictionary.select("frag_id", "collection", "hash", F.col("len").cast("long").alias("len"), F.col("size").cast("long").alias("size"))


@query
def versioned_lookup(spark, sf_dir):
    """Places of a phrase in every version, found in the fragments and resolved through their applications."""
    return versioned.lookup_phrase(versioned_of(spark, sf_dir), ["of", "the"])


@query
def versioned_reduction(spark, sf_dir):
    """Postings of the versioned index against one of all versions."""
    found = versioned_of(spark, sf_dir)
    after = found.dictionary.agg(F.sum("len").cast("long").alias("after"), F.count(F.lit(1)).alias("n_frags"))
    apps = found.metadata.agg(F.count(F.lit(1)).alias("n_apps"))
    before = corpus.token_arrays(spark, sf_dir).agg(F.sum(F.size("toks")).alias("before"))  # each document is a version
    return before.crossJoin(after).crossJoin(apps)  # one row each


def _metadata(spark, sf_dir) -> DataFrame:
    found = versioned_of(spark, sf_dir)
    return found.metadata.join(found.dictionary.select("frag_id", "len"), "frag_id")


@query
def metadata_file(spark, sf_dir):
    """Fragment metadata as nested tables, written and scanned."""
    at = _folder(spark, "metadata")
    sinks.write_metadata(_metadata(spark, sf_dir), at)
    return sinks.read_metadata(spark, at).select(*(F.col(c).cast("long").alias(c) for c in ("frag_id", "len", "version", "offset")))


@query
def metadata_varbyte(spark, sf_dir):
    """Fragment metadata in the variable-length code, written and decoded."""
    at = _folder(spark, "metadata")
    sinks.write_metadata_varbyte(_metadata(spark, sf_dir), at)
    return sinks.read_metadata_varbyte(spark, at)


# --- binary layouts --------------------------------------------------------------


def _through(rows: DataFrame, layout: str) -> DataFrame:
    """rows, written in a binary layout and read back."""
    spark = rows.sparkSession
    layouts.register(spark)
    at = _folder(spark, layout)
    rows.write.format(layout).mode("overwrite").save(at)
    return spark.read.format(layout).load(at)


def numbered_versions(spark, sf_dir) -> DataFrame:
    """doc, version, toks: collections by their smallest document id, each in one partition, in files' order."""
    first = F.min("doc_id").over(Window.partitionBy("collection"))
    named = corpus.version_texts(spark, sf_dir).select(first.alias("doc"), F.col("version").cast("long").alias("version"), "text")
    # a document is a collection, so it is in one partition already
    return named.sortWithinPartitions("doc", "version").select("doc", "version", corpus.joined_tokens().alias("toks"))


def _digest(col) -> F.Column:
    return F.md5(F.array_join(F.col(col).cast("array<string>"), " "))


@query
def layout_corpus(spark, sf_dir):
    """Word ids of all versions, through corpus files."""
    ids = F.transform("toks", corpus.word_id)
    rows = _through(numbered_versions(spark, sf_dir).select("doc", "version", ids.alias("toks")), "corpus_files")
    return rows.select("doc", "version", F.size("toks").cast("long").alias("n"), _digest("toks").alias("toks"))


@query
def layout_postings(spark, sf_dir):
    """Posting lists of each version, through a file per document."""
    lists = kernels.with_word_lists(numbered_versions(spark, sf_dir), "doc", "version")
    back = kernels.with_words(_through(lists, "posting_files"), "doc", "version").where(F.size("toks") > 0)
    return back.select("doc", "version", F.size("toks").cast("long").alias("n"), _digest("toks").alias("toks"))


@query
def layout_index(spark, sf_dir):
    """The inverted index of all documents by word id, through index files."""
    rows = index.term_rows(corpus.token_arrays(spark, sf_dir), "doc_id").withColumn("term", corpus.word_id().cast("string"))
    blocks = index.build(rows.groupBy("doc_id", "term").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")))
    wide = F.transform("postings", lambda p: F.struct(p["docid"].cast("long").alias("docid"), p["pos"].cast("long").alias("pos")))
    ready = scratch.table(blocks.select(F.col("term").cast("long").alias("wid"), "block", wide.alias("postings")), "blocks").repartitionByRange("wid").sortWithinPartitions("wid", "block")
    back = _through(ready.select("wid", "postings"), "index_files")
    return back.select("wid", F.size("postings").cast("long").alias("freq"), list_digest(lambda p: [p["docid"]]).alias("postings"))


@query
def layout_fragments(spark, sf_dir):
    """Fragment metadata of the versioned index, through a fragment file."""
    rows = sinks.gathered(_metadata(spark, sf_dir))
    wide = F.transform("apps", lambda a: F.struct(a["version"].cast("long").alias("version"), a["offset"].cast("long").alias("offset")))
    back = _through(rows.select(F.col("frag_id").cast("long").alias("frag_id"), F.col("len").cast("long").alias("len"), wide.alias("apps")), "fragment_files")
    return back.select("frag_id", "len", F.explode("apps").alias("a")).select("frag_id", "len", "a.version", "a.offset")


__all__ = ["ORACLE_SQL", "QUERIES", "SWEEP"]
