"""The library's operators as queries over the driver's tables, each over whole tables."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomry.functions import arrow_text
from fathomry.functions import text as T
from fathomry.functions.vectors import hashed_rows, hashed_sparse
from fathomry.operators import advisor, chunking, graph, index, locate, maintain, metrics, search, table_functions
from fathomry.operators.common import checked_broadcast
from fathomry.session import shared_folder, written
from fathomry.sources import documents as sources
from fathomry.sources.store import Store
from fathomry.streaming import outbox, tracking


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def structured(docs: DataFrame) -> DataFrame:
    """doc_id, title, sections: a document's lines as paragraphs, four in a section."""
    lines = docs.select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "").alias("lines")).where(F.size("lines") > 0)
    section = lambda k: F.struct(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.concat(F.lit("Part "), k.cast("string")).alias("title"), F.slice("lines", k * 4 + 1, 4).alias("paras"))
    numbers = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 4).cast("int"))
    return lines.select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.transform(numbers, section).alias("sections"))


def markdown(docs: DataFrame) -> DataFrame:
    """doc_id, text: the same as markdown with numbered provisions, each of which refers to the one before."""
    def part(s, k):
        n = k + 1
        see = F.when(k > 0, F.concat(F.lit("\nSee Section "), k.cast("string"), F.lit(".1."))).otherwise(F.lit(""))
        return F.concat(F.lit("## "), n.cast("string"), F.lit(" "), s["title"], F.lit("\n### "), n.cast("string"), F.lit(".1 Rule\n"), F.array_join(s["paras"], "\n"), see)

    rows = structured(docs)
    return rows.select("doc_id", F.concat(F.lit("# "), "title", F.lit("\n"), F.array_join(F.transform("sections", part), "\n")).alias("text"))


# --- text ------------------------------------------------------------------------------------------------------------


def tokenize_stats(spark, sf_dir):
    def run(batches):
        for batch in batches:
            done = 0
            for texts in arrow_text.slices(batch.column("text")):
                found, raw = arrow_text.terms(texts, stemmed=True)
                counts = [arrow_text.word_counts(texts), raw, pc.list_value_length(found), arrow_text.distinct_counts(found)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(texts)), *[pa.array(x).cast(pa.int64()) for x in counts]], names=["doc_id", "n_words", "n_raw", "n_tokens", "n_stems"])
                done += len(texts)

    rows = _docs(spark, sf_dir).select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_raw long, n_tokens long, n_stems long")


def normalize_text(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


def sentence_split(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


def fnv_hash(spark, sf_dir):
    return _asked(spark, sf_dir).select("query_id", T.fnv_hex(F.col("text")).alias("hash"))


def page_text(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", sources.markup_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


# --- index and search ------------------------------------------------------------------------------------------------


def _index(spark, sf_dir, **options) -> index.Index:
    return index.build_index(_docs(spark, sf_dir), key="doc_id", **options)


def postings(spark, sf_dir):
    return index.postings(_docs(spark, sf_dir), key="doc_id")


def corpus_stats(spark, sf_dir):
    return rounded(_index(spark, sf_dir).stats, "mean_length")


def bm25_topk(spark, sf_dir):
    return rounded(index.bm25(_index(spark, sf_dir), _asked(spark, sf_dir)), "score")


def mini_bm25_topk(spark, sf_dir):
    return rounded(index.bm25(_index(spark, sf_dir, tokenizer="stem", measure="tokens"), _asked(spark, sf_dir)), "score")


def vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return rounded(search.vector_topk(rows, asked), "score")


def hashed_embedding_sparse(spark, sf_dir):
    return rounded(hashed_sparse(_docs(spark, sf_dir), "doc_id", "text"), "weight")


def _hashed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The hashed vectors of documents and of questions."""
    docs = hashed_rows(_docs(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id"), "chunk_id", "text")
    return docs, written(hashed_rows(_asked(spark, sf_dir), "query_id", "text"), "asked")


def hashed_search(spark, sf_dir):
    return rounded(search.sparse_topk(*_hashed(spark, sf_dir), 5), "score")


def _candidates(spark, sf_dir) -> DataFrame:
    docs, asked = _hashed(spark, sf_dir)
    docs = written(docs, "vectors")
    keyword = index.bm25(_index(spark, sf_dir), _asked(spark, sf_dir), search.CANDIDATES)
    return search.candidates(search.sparse_topk(docs, asked, search.CANDIDATES), keyword, cosines=lambda pairs: search.sparse_cosines(docs, asked, pairs))


def hybrid_fusion(spark, sf_dir):
    return rounded(search.fuse(_candidates(spark, sf_dir)), "vector_score", "keyword_score", "keyword_part", "score")


def retrieval_modes(spark, sf_dir):
    return rounded(search.modes(_candidates(spark, sf_dir)).select("query_id", "mode", "rank", "chunk_id", "score"), "score")


def _enriched(spark, sf_dir, found: DataFrame) -> DataFrame:
    found = written(found, "found")
    docs = _docs(spark, sf_dir).join(checked_broadcast(found.select(F.col("chunk_id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(1).alias("page"), "text")
    return search.enrich(found, chunks, docs.select("doc_id", F.col("source").alias("name")))


def retrieval_stages(spark, sf_dir):
    """Rows of each stage of a hybrid retrieval, whether it was timed, and the average confidence of what it returns."""
    stages = search.Stages(spark)
    docs, asked = _hashed(spark, sf_dir)
    docs = stages.run("vectors", docs)
    by_vector = stages.run("vector", search.sparse_topk(docs, asked, search.CANDIDATES))
    by_keyword = stages.run("keyword", index.bm25(_index(spark, sf_dir), _asked(spark, sf_dir), search.CANDIDATES))
    fused = stages.run("fused", search.fuse(search.candidates(by_vector, by_keyword, cosines=lambda pairs: search.sparse_cosines(docs, asked, pairs))))
    best = stages.run("best", search.rerank(fused, "none"))
    confidence = search.mean_confidence(best).agg(F.round(F.avg("mean_confidence"), 6).alias("confidence"))
    return stages.table().select("stage", "n_rows", (F.col("seconds") > 0).alias("timed")).join(F.broadcast(confidence))


def link_rank(spark, sf_dir):
    """Documents that PageRank mass reaches from each question's best ones, over links across documents.

    Links: neighbours by doc_id within a source, and a passage's first document with the others that hold it.
    """
    docs, asked = _docs(spark, sf_dir), _asked(spark, sf_dir)
    beside = docs.select(F.col("doc_id").alias("a"), F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("b"), F.lit(1.0).alias("weight"))
    held = written(locate.located(docs, asked), "held")
    firsts = held.groupBy("query_id").agg(F.min("doc_id").alias("a"))
    shared = held.join(firsts, "query_id").where("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.lit(2.0).alias("weight"))
    best = index.bm25(_index(spark, sf_dir), asked, graph.SEEDS)
    seeds = best.select("query_id", F.col("chunk_id").alias("node"), (F.col("score") / F.sum("score").over(Window.partitionBy("query_id"))).alias("mass"))
    mass = graph.spread(beside.where("b is not null").unionAll(shared), seeds)
    return rounded(index.top(mass.withColumnRenamed("node", "chunk_id").withColumnRenamed("mass", "score"), 10), "score")


def rerank_proximity(spark, sf_dir):
    found = _enriched(spark, sf_dir, search.fuse(_candidates(spark, sf_dir)))
    asked = _asked(spark, sf_dir).withColumnRenamed("text", "query")
    return rounded(search.rerank(found.join(asked, "query_id")).select("query_id", "rank", "chunk_id", "confidence"), "confidence")


def context_assembly(spark, sf_dir):
    found = _enriched(spark, sf_dir, search.fuse(_candidates(spark, sf_dir), k=search.TOP))
    return search.context(found).select("query_id", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("digest"))


def answers(spark, sf_dir):
    """Prompt, extractive answer and its citations for each question, with groundedness scores."""
    found = search.context(_enriched(spark, sf_dir, search.fuse(_candidates(spark, sf_dir), k=search.TOP)))
    asked = found.join(_asked(spark, sf_dir).withColumnRenamed("text", "query"), "query_id")
    scored = metrics.groundedness(search.generate(asked))
    cited = F.array_join(T.citations(F.col("context")).cast("array<string>"), ",").alias("cited")
    return rounded(scored.select("query_id", F.length(search.prompt(F.col("query"), F.col("context"))).cast("long").alias("prompt_chars"), "answer", cited, "faithfulness", "flagged"), "faithfulness")


def doc_delete_cascade(spark, sf_dir):
    """What an index holds once the documents of one source are deleted."""
    docs = _docs(spark, sf_dir)
    left = index.without_documents(_index(spark, sf_dir), docs.where("source = 'src0'"), docs.select("doc_id", F.col("doc_id").alias("chunk_id")))
    sizes = left.lengths.agg(F.count(F.lit(1)).alias("n_chunks"))
    postings = left.blocks.agg(F.coalesce(F.sum(F.get("ends", F.size("ends") - 1)), F.lit(0)).alias("n_postings"))
    terms = left.blocks.select(F.explode("terms").alias("term")).agg(F.countDistinct("term").alias("n_terms"))
    return postings.join(F.broadcast(terms)).join(F.broadcast(sizes))


def store_stats(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    chunks = chunking.fixed_chunks(docs)
    return docs.agg(F.count(F.lit(1)).alias("n_documents")).join(F.broadcast(chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("words").cast("long").alias("n_words"))))


def store_upsert(spark, sf_dir):
    """A store of all documents, after every tenth was replaced by a revised one: what it holds of each document."""
    docs = _docs(spark, sf_dir).where("text is not null").select("doc_id", F.col("source").alias("name"), "text")
    revised = docs.where("doc_id % 10 = 0").select("doc_id", F.lit("revised").alias("name"), F.concat(F.lit("A revised edition. "), "text").alias("text"))
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    for rows in (docs, revised):
        chunks = chunking.fixed_chunks(rows)
        store.upsert(rows, chunks.select(F.concat_ws("-", "doc_id", "chunk_no").alias("chunk_id"), "doc_id", "text"))
    n_chunks = store.table("chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    terms = store.table("postings").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_terms"))
    out = store.table("documents").select("doc_id", "name", F.md5("text").alias("digest")).join(n_chunks, "doc_id", "left").join(terms, "doc_id", "left")
    return out.fillna(0, ["n_chunks", "n_postings", "n_terms"])


# --- metrics ---------------------------------------------------------------------------------------------------------


def _judged(spark, sf_dir) -> DataFrame:
    found = index.bm25(_index(spark, sf_dir), _asked(spark, sf_dir), k=10)
    return metrics.labelled(found.withColumnRenamed("chunk_id", "doc_id"), table(spark, sf_dir, "labels"))


def ir_metrics(spark, sf_dir):
    return rounded(metrics.ranking_metrics(_judged(spark, sf_dir)), "precision", "recall", "mrr", "ndcg", "average_precision")


def pr_curve(spark, sf_dir):
    return rounded(metrics.precision_recall_curve(_judged(spark, sf_dir)), "precision", "recall")


def groundedness(spark, sf_dir):
    """Assistant turns against the user's turn and the turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lag("role").over(w).alias("asker"), F.lag("text").over(w).alias("query"), F.lag("text", 2).over(w).alias("before"))
    rows = rows.where("role = 'assistant' and asker = 'user'").select("conv_id", "turn", "query", F.col("text").alias("answer"), F.concat_ws("\n", "before", "query").alias("context"))
    out = metrics.groundedness(rows).select("conv_id", "turn", "context_relevance", "answer_relevance", "faithfulness", F.size("mismatches").cast("long").alias("n_mismatches"), "flagged")
    return rounded(out, "context_relevance", "answer_relevance", "faithfulness")


# --- chunks ----------------------------------------------------------------------------------------------------------


def _digest(chunks: DataFrame, *more: str) -> DataFrame:
    return chunks.select("doc_id", *more, F.md5("text").alias("digest"))


def fixed_chunks(spark, sf_dir):
    return _digest(chunking.fixed_chunks(_docs(spark, sf_dir)).withColumn("words", F.col("words").cast("long")), "chunk_no", "start", "end", "words")


def section_windows(spark, sf_dir):
    return _digest(chunking.section_windows(structured(_docs(spark, sf_dir))), "pos", "section")


def stable_chunks(spark, sf_dir):
    return _digest(chunking.stable_chunks(structured(_docs(spark, sf_dir))), "pos", "section")


def sentence_chunks(spark, sf_dir):
    return _digest(chunking.sentence_chunks(_docs(spark, sf_dir).withColumn("page", F.lit(1))), "chunk_no", "n_tokens")


def record_chunks(spark, sf_dir):
    """Orders as tables of comma-separated lines, one table for each customer, cut into row groups under their header."""
    line = F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("rows"))
    text = F.concat(F.lit("order,status,price,priority\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return _digest(chunking.lab_chunks(rows.select("doc_id", text.alias("text")), "record"), "chunk_no", "words")


def _located(spark, sf_dir) -> DataFrame:
    """doc_id, query_id, q, evidence, start, end, split: the benchmark passages that documents hold verbatim.

    Half of the questions, by a hash, are for training: supervised chunkers see no others.
    """
    asked = _asked(spark, sf_dir)
    found = locate.located(markdown(_docs(spark, sf_dir)), asked)
    evidence = asked.select("query_id", F.col("text").alias("q"), F.split("text", r"(?<=[.!?])\s+").alias("evidence"))
    return found.join(evidence, "query_id").select("doc_id", "query_id", "q", "evidence", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.when(F.crc32(F.col("query_id").cast("string")) % 2 == 0, "train").otherwise("test").alias("split"))


def evidence_location(spark, sf_dir):
    return _located(spark, sf_dir).select("doc_id", "query_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _lab(spark, sf_dir) -> DataFrame:
    """The chunks of every strategy, those by structure and records aside under their heading path."""
    docs = markdown(_docs(spark, sf_dir))
    wanted = _located(spark, sf_dir).where("split = 'train'").groupBy("doc_id").agg(F.sort_array(F.collect_set("evidence")).alias("questions"))
    return chunking.lab_chunks(docs.join(wanted, "doc_id", "left"), ("fixed", "sentence", "struct", "qesdp", "qesov"))


def lab_chunks(spark, sf_dir):
    return _digest(_lab(spark, sf_dir), "strategy", "chunk_no", "start", "end", "words")


def sql_chunks(spark, sf_dir):
    """Documents' units packed by a table function of SQL."""
    table_functions.register(spark)
    found = spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunks(d.text, 'sentence', 450) c", docs=_docs(spark, sf_dir))
    return _digest(found, "chunk_no", "start", "end", "words")


def headed_chunks(spark, sf_dir):
    docs = markdown(_docs(spark, sf_dir))
    return _digest(chunking.with_heading_path(chunking.lab_chunks(docs, "fixed"), chunking.provisions(docs)), "chunk_no", "words")


def chunk_preview(spark, sf_dir):
    return rounded(chunking.preview(chunking.lab_chunks(markdown(_docs(spark, sf_dir)), "struct")), "heading_share")


def _questioned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    asked = written(_located(spark, sf_dir), "asked")
    return written(_lab(spark, sf_dir).join(asked.select("doc_id").distinct(), "doc_id", "left_semi"), "lab"), asked


def recommended_preview(spark, sf_dir):
    """Documents chunked by structure as a recommendation would, with what falls back and what is too big for its budget."""
    return rounded(chunking.previewed(markdown(_docs(spark, sf_dir)), "struct"), "heading_share")


def chunk_graph_edges(spark, sf_dir):
    docs = markdown(_docs(spark, sf_dir))
    out = graph.edges(chunking.lab_chunks(docs, "struct"), chunking.provisions(docs))
    return rounded(out.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("weight")), "weight")


def budget_curve(spark, sf_dir):
    """Evidence recall of each strategy, flat and by graph, at every word budget: on questions that chunkers were fitted on, and on others."""
    chunks, asked = _questioned(spark, sf_dir)
    docs = markdown(_docs(spark, sf_dir)).join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    links = written(graph.edges(chunks, chunking.provisions(docs)), "links")
    flat = written(graph.lab_scores(chunks, asked), "scores")
    terms = chunks.select("doc_id", "strategy", F.col("chunk_no").cast("long").alias("chunk_no"), "words", T.stems(F.col("text")).alias("terms"))
    out = []
    for mode, scored in (("flat", flat), ("graph", graph.graph_scores(flat, links))):
        scored = scored.withColumn("chunk_no", F.col("chunk_no").cast("long")).join(terms, ["doc_id", "strategy", "chunk_no"])
        picked = graph.assemble(scored, graph.BUDGETS)
        picked = written(picked, "picked")
        for split in ("train", "test"):
            own = asked.where(F.col("split") == split)
            found = picked.join(own.select("doc_id", "query_id").distinct(), ["doc_id", "query_id"], "left_semi")
            out.append(graph.evidence_recall(found, chunks, own, ["strategy", "budget"]).withColumn("mode", F.lit(mode)).withColumn("split", F.lit(split)))
    return rounded(reduce(DataFrame.unionByName, out), "complete", "partial")


def lab_metrics(spark, sf_dir):
    """Size, clean boundaries, intact evidence and resolved references of each strategy."""
    docs = markdown(_docs(spark, sf_dir))
    chunks, asked = written(_lab(spark, sf_dir), "lab"), _located(spark, sf_dir)
    units, parts = chunking.units(docs), chunking.provisions(docs)
    clean = graph.boundaries(chunks, units).groupBy("strategy").agg(F.avg("clean").alias("clean"))
    out = graph.shape(chunks, docs).join(clean, "strategy", "left").join(graph.intact_evidence(chunks, asked), "strategy", "left").join(graph.resolved_references(chunks, parts, units), "strategy", "left")
    return rounded(out, "index_ratio", "clean", "intact", "resolved")


# --- advisor ---------------------------------------------------------------------------------------------------------


def doc_signals(spark, sf_dir):
    means = ["code_fences", "ocr_noise", "mean_sentence_words", "mean_paragraph_words"]
    out = advisor.profile(_docs(spark, sf_dir))
    counts = [F.col(c).cast("long").alias(c) for c in out.columns if c not in ("doc_id", *means)]
    return out.select("doc_id", *counts, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in means])


def doc_category(spark, sf_dir):
    out = advisor.classify(advisor.profile(_docs(spark, sf_dir))).where(F.col("chars") >= advisor.LEAST_CHARS)
    return out.select("doc_id", "category", F.round(F.col("ranked")[0]["score"], 6).alias("score"), F.round(F.col("ranked")[0]["share"], 6).alias("share"))


def recommend(spark, sf_dir):
    out = advisor.recommend(advisor.classify(advisor.profile(_docs(spark, sf_dir))), budget="small", retriever="bm25")
    return out.select("doc_id", "category", "strategy", "low", "high", "overlap", "lab_size", "budget_words", "retrieval", F.size("notes").alias("n_notes"))


# --- maintenance -----------------------------------------------------------------------------------------------------


def _edited(rows: DataFrame) -> DataFrame:
    """A sentence more at the start of every third document."""
    return rows.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("A new first sentence. "), "text")).otherwise(F.col("text")))


def hash_diff(spark, sf_dir):
    """What an edit embeds anew, under windows and under stable chunks."""
    docs = _docs(spark, sf_dir).where("text is not null")
    windows = [chunking.fixed_chunks(d, 400, 0).withColumnRenamed("chunk_no", "pos") for d in (docs, _edited(docs))]
    stable = [chunking.stable_chunks(structured(d)) for d in (docs, _edited(docs))]
    out = [maintain.diff_summary(maintain.hash_diff(*own)).withColumn("chunker", F.lit(n)) for n, own in (("windows", windows), ("stable", stable))]
    return out[0].unionByName(out[1])


def replaced_chunks(spark, sf_dir):
    docs = _docs(spark, sf_dir).where("text is not null")
    out = maintain.replaced(*[chunking.stable_chunks(structured(d)) for d in (docs, _edited(docs))])
    return out.select("doc_id", "n", F.md5("deleted").alias("deleted"), F.md5("inserted").alias("inserted"))


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of versions 12 and 13, of which every third document's later half hasn't landed; pointers; expected rows."""
    rows = chunking.stable_chunks(structured(_docs(spark, sf_dir))).select("doc_id", "pos")
    sizes = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
    new = rows.join(sizes, "doc_id").select("doc_id", "pos", F.lit(13).alias("version"), ((F.col("doc_id") % 3 != 0) | (F.col("pos") * 2 < F.col("n_rows"))).alias("visible"))
    old = rows.select("doc_id", "pos", F.lit(12).alias("version"), F.lit(True).alias("visible"))
    return old.unionByName(new), sizes.select("doc_id", F.lit(12).alias("version")), sizes.select("doc_id", F.lit(13).alias("version"), "n_rows")


def version_active(spark, sf_dir):
    """doc_id, active version and what its readers see, if versions switch at once or only when complete."""
    rows, active, expected = _versions(spark, sf_dir)
    safe = maintain.activated(active, rows, expected)
    early = maintain.coverage(rows, expected.select("doc_id", "version"), expected).withColumnRenamed("coverage", "early_coverage")
    out = safe.join(maintain.coverage(rows, safe, expected), "doc_id").join(early, "doc_id")
    return rounded(out.select("doc_id", F.col("version").alias("active"), "coverage", "early_coverage"), "coverage", "early_coverage")


def collected_rows(spark, sf_dir):
    rows, active, expected = _versions(spark, sf_dir)
    kept = maintain.collected(rows, maintain.activated(active, rows, expected), keep=0)
    return kept.groupBy("doc_id").agg(F.min("version").alias("oldest"), F.count(F.lit(1)).alias("n_rows"))


def _updates(spark, sf_dir) -> DataFrame:
    """doc_id, version, hash, ts, lost: the events as a feed of updates, of which errors are lost."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), F.row_number().over(w).cast("long").alias("version"), F.md5(F.concat_ws("|", F.col("event_id").cast("string"), "props")).alias("hash"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("lost"))
    return rows.drop("event_id")


def gc_series(spark, sf_dir):
    edits = _updates(spark, sf_dir).select("doc_id", F.col("version").alias("edit"), (1 + F.col("doc_id") % 60).alias("n_chunks"))
    return maintain.gc_series(edits)


def drift(spark, sf_dir):
    rows = _updates(spark, sf_dir)
    return maintain.drift(outbox.latest(rows), outbox.latest(rows.where("not lost")))


def reconcile(spark, sf_dir):
    rows = _updates(spark, sf_dir)
    return maintain.reconciled(outbox.latest(rows), outbox.latest(rows.where("not lost")))


def sequence_gaps(spark, sf_dir):
    return outbox.sequence_gaps(_updates(spark, sf_dir).where("not lost"))


def stream_index(spark, sf_dir):
    """The feed through a stream of files into the index; lost events are missing."""
    folder = f"{shared_folder(spark)}/outbox-{uuid.uuid4().hex}"
    _updates(spark, sf_dir).where("not lost").drop("lost").write.parquet(f"{folder}/events")
    outbox.start(outbox.event_stream(spark, f"{folder}/events"), f"{folder}/index", f"{folder}/checkpoint").awaitTermination()
    return outbox.indexed(spark, f"{folder}/index")


def stream_gaps(spark, sf_dir):
    """Lost events as the stateful stream finds them, from files that are in no order of time."""
    folder = f"{shared_folder(spark)}/tracked-{uuid.uuid4().hex}"
    _updates(spark, sf_dir).where("not lost").drop("lost").repartition(3, "version").write.parquet(f"{folder}/events")
    tracking.start(outbox.event_stream(spark, f"{folder}/events"), f"{folder}/states", f"{folder}/checkpoint").awaitTermination()
    return tracking.gaps(tracking.tracked(spark, f"{folder}/states"))


def update_rates(spark, sf_dir):
    out = outbox.rates(_updates(spark, sf_dir))
    return out.select(F.col("window.start").alias("start"), "events")


def cache_valid(spark, sf_dir):
    """An answer for each source and language cites its first and last document; every seventh document has moved on."""
    docs = _docs(spark, sf_dir)
    cited = F.array_distinct(F.array(F.min("doc_id"), F.max("doc_id")))
    cache = docs.groupBy("source", "lang").agg(cited.alias("c")).select(F.concat_ws("|", "source", "lang").alias("key"), F.lit("an answer").alias("answer"), F.map_from_arrays("c", F.transform("c", lambda x: F.lit(1))).alias("sources"))
    active = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1).alias("version"))
    return maintain.cache_lookup(cache, active).select("key", "valid")


def model_mix(spark, sf_dir):
    """Recall of the passages' documents when a quarter of the documents has vectors of a newer model."""
    docs, asked = _docs(spark, sf_dir), _asked(spark, sf_dir)
    vectors = {m: hashed_rows(docs, "doc_id", "text", seed=f"{m}|").withColumn("model", F.lit(m)) for m in ("v1", "v2")}
    mixed = vectors["v1"].where("doc_id % 4 <> 0").unionByName(vectors["v2"].where("doc_id % 4 = 0"))
    expected = _located(spark, sf_dir).groupBy("query_id").agg(F.min("doc_id").alias("expected"))
    out = None
    for name, rows, model in (("before", vectors["v1"], "v1"), ("mixed, new queries", mixed, "v2"), ("mixed, old queries", mixed, "v1"), ("after", vectors["v2"], "v2")):
        found = search.sparse_topk(rows.withColumnRenamed("doc_id", "chunk_id"), hashed_rows(asked, "query_id", "text", seed=f"{model}|"), 5)
        own = metrics.recall_of_expected(found.withColumnRenamed("chunk_id", "doc_id"), expected).withColumn("index", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return rounded(out.select("index", "recall"), "recall")


_ALL = (
    tokenize_stats, normalize_text, sentence_split, fnv_hash, page_text, postings, corpus_stats, bm25_topk, mini_bm25_topk, vector_topk, hashed_embedding_sparse, hashed_search,
    hybrid_fusion, retrieval_modes, retrieval_stages, link_rank, rerank_proximity, context_assembly, answers, doc_delete_cascade, store_stats, store_upsert, ir_metrics, pr_curve, groundedness, fixed_chunks, section_windows,
    stable_chunks, sentence_chunks, record_chunks, evidence_location, lab_chunks, sql_chunks, headed_chunks, chunk_preview, recommended_preview, chunk_graph_edges, budget_curve, lab_metrics, doc_signals, doc_category,
    recommend, hash_diff, replaced_chunks, version_active, collected_rows, gc_series, drift, reconcile, sequence_gaps, stream_index, stream_gaps, update_rates, cache_valid, model_mix,
)
QUERIES = {f.__name__: f for f in _ALL}
