"""The library's queries over a folder of tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import layout, text
from ..operators import boolean, codec, correct, errmodel, gate, index, lm, trie
from ..sources import crawl, querylog
from ..sources.querylog import LOG_SQL, sql_literal
from ..streaming import stream
from . import saved
from .storage import shared_dir, table

FLAGSHIP = "(the&and)|!of"
#: name -> query, over documents; every operator of the boolean language.
BOOLEAN = {
    "bool_term": "the",
    "bool_case_fold": "THE",
    "bool_unknown_term": "zzzzqq",
    "bool_and": "the&and",
    "bool_and_op_op": "(the|der)&(and|und)",
    "bool_and_op_term": "(the|der)&of",
    "bool_and_not_term": "the&!and",
    "bool_and_not_op": "the&!(and|of)",
    "bool_and_not_not": "!the&!and",
    "bool_or": "der|le",
    "bool_or_op_op": "(the&and)|(der&und)",
    "bool_or_op_term": "(the&and)|der",
    "bool_or_not_term": FLAGSHIP,
    "bool_or_not_op": "der|!(the&and)",
    "bool_or_not_not": "!the|!and",
    "bool_or_not_unknown": "the|!zzzzqq",
    "bool_not_root": "!the",
    "bool_double_not": "!!(the&and)",
    "bool_nested_double_not": "the&!!and",
    "bool_precedence": "der|the&and",
}
BATCH = ["the&and", "!of", FLAGSHIP, "der|le", "the and", "zzzzqq", "(the"]
STREAM = [*BATCH, "", BATCH[0]]
#: Header and text of archive records; the texts' first character goes, and so does a part of one character.
CRAWL = [(f"header http://example.org/{i} end", f".text {i}\nline") for i in range(5)] + [("no url", ".x"), ("http://example.org/short", "s")]
ROUNDS = 20
_gates: dict = {}


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text")


def postings(spark, sf):
    """The index: built on first use, then read with the terms pushed down."""
    return table(spark, "postings", sf, lambda: index.sorted_postings(documents(spark, sf)))


def ids(spark, sf):
    return read(spark, sf, "documents").select("doc_id")


def flagship(spark, sf):
    return boolean.search(boolean.parse(FLAGSHIP), postings(spark, sf), ids(spark, sf))


def _flags(query, spark, sf):
    return boolean.search(boolean.parse(query), postings(spark, sf), ids(spark, sf))


def bool_setops(spark, sf):
    return boolean.search_sets(boolean.parse(FLAGSHIP), postings(spark, sf), ids(spark, sf))


def bool_arrays(spark, sf):
    p = postings(spark, sf).filter(F.col("term").isin(boolean.terms(boolean.parse(FLAGSHIP))))
    return boolean.search_arrays(boolean.parse(FLAGSHIP), index.posting_lists(p), ids(spark, sf))


def bool_scan(spark, sf):
    return boolean.search_scan(boolean.parse(FLAGSHIP), documents(spark, sf))


def bool_batch(spark, sf):
    return boolean.search_batch(list(enumerate(BATCH)), postings(spark, sf), ids(spark, sf)).filter("error is null").select("qid", "doc_id")


def bool_errors(spark, sf):
    return boolean.search_batch(list(enumerate(BATCH)), postings(spark, sf), ids(spark, sf)).filter("error is not null").select("qid")


def idx_postings(spark, sf):
    return postings(spark, sf).select("term", "doc_id")


def idx_df(spark, sf):
    return index.document_frequency(postings(spark, sf))


def idx_dict_size(spark, sf):
    return postings(spark, sf).agg(F.countDistinct("term").alias("n_terms"), F.count("*").alias("n_postings"))


def tok_count_per_doc(spark, sf):
    words = text.all_matches(F.lower("text"), text.WORD)
    return documents(spark, sf).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_terms"))


def simple9_roundtrip(spark, sf):
    """Lists through the codec and back; a list holds the ids of one range, less its start, so neither rows nor ids are bounded."""
    part = F.floor(F.col("doc_id") / codec.RANGE)
    lists = postings(spark, sf).groupBy("term", part.alias("part")).agg(F.array_sort(F.collect_list(F.col("doc_id") - part * codec.RANGE)).alias("ids"))
    words = lists.select("term", "part", F.size("ids").alias("n"), codec.simple9_encode("ids").alias("words"))
    return words.select("term", "part", F.explode(codec.simple9_decode("words", "n")).alias("at")).select("term", (F.col("at") + F.col("part") * codec.RANGE).alias("doc_id"))


def saved_index(spark, sf):
    """An index folder, written here and opened anew."""
    folder = shared_dir(spark, "index")
    saved.save_index(documents(spark, sf), read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url"), folder)
    return saved.load_index(spark, folder)


def index_reload(spark, sf):
    return saved_index(spark, sf).postings.select("term", "doc_id")


def simple9_index(spark, sf):
    """The postings of a saved index's blobs."""
    return codec.postings_of(saved_index(spark, sf).blobs).select("term", "doc_id")


def search_saved(spark, sf):
    """The matches of a saved index with their URLs."""
    own = saved_index(spark, sf)
    return boolean.with_urls(boolean.search(boolean.parse(FLAGSHIP), own.postings, own.ids), own.urls)


def url_extract(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.extract_url(F.col("url")).alias("url_found"))


def text_clean(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.clean_text(F.col("html")).alias("clean"))


def url_lines(spark, sf):
    return index.url_table(read(spark, sf, "pages"))


def result_urls(spark, sf):
    urls = read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return boolean.with_urls(_flags("the&and", spark, sf), urls)


def result_counts(spark, sf):
    return _flags("the&and", spark, sf).agg(F.count("*").alias("n"))


def result_lines(spark, sf):
    """The answer to one query as lines: the count, then the URLs."""
    urls = read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return boolean.result_lines(_flags("the&and", spark, sf), urls)


def lines(spark, sf):
    """Log lines of one, two and three columns."""
    p = read(spark, sf, "part")
    k = F.col("p_partkey") % 3
    value = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat_ws("\t", "p_brand", "p_name")).otherwise(F.concat_ws("\t", "p_type", "p_name", "p_brand"))
    return querylog.parse_lines(p.select(value.alias("value")))


def log_lines(spark, sf):
    """How many lines give each pair of columns."""
    return lines(spark, sf).groupBy("wrong", "right", "ncols").agg(F.count("*").alias("n"))


def log_lines_labelled(spark, sf):
    return querylog.labelled(lines(spark, sf).withColumn("qid", F.lit(0))).groupBy("text", "need_fix").agg(F.count("*").alias("n"))


def log_lines_pairs(spark, sf):
    """Training pairs: only lines of two columns and equally many words on both sides."""
    return errmodel.word_pairs(lines(spark, sf)).groupBy("right", "wrong").agg(F.count("*").alias("n"))


def log(spark, sf):
    return querylog.log_of_parts(read(spark, sf, "part"))


def log_columns(spark, sf):
    return log(spark, sf)


def log_labelled(spark, sf):
    return querylog.labelled(log(spark, sf))


def unigrams(spark, sf):
    return table(spark, "unigrams", sf, lambda: lm.unigrams(lm.tokens(log(spark, sf))))


def bigrams(spark, sf):
    return lm.bigrams(log(spark, sf), unigrams(spark, sf))


def facts(spark, sf):
    return unigrams(spark, sf).agg(F.sum("cnt").alias("n_tokens")).select("n_tokens", (1 / F.col("n_tokens")).alias("smooth"))


def lm_unigram(spark, sf):
    return unigrams(spark, sf).select("word", "cnt", F.round("p", 12).alias("p"))


def lm_bigram(spark, sf):
    return bigrams(spark, sf).select("w1", "w2", "cnt", F.round("p", 12).alias("p"))


def lm_smooth(spark, sf):
    return facts(spark, sf).select("n_tokens", F.round("smooth", 12).alias("smooth"))


def typed(spark, sf):
    """Every query of the log as typed."""
    return log(spark, sf).select("qid", F.coalesce("wrong", "right").alias("text"))


def lm_query_prob(spark, sf):
    return lm.query_probability(typed(spark, sf), unigrams(spark, sf), bigrams(spark, sf), facts(spark, sf)).select("qid", F.round("prob", 9).alias("prob"))


def feature_table(spark, sf):
    return lm.features(typed(spark, sf), unigrams(spark, sf), bigrams(spark, sf), facts(spark, sf))


def features(spark, sf):
    return feature_table(spark, sf).withColumn("prob", F.round("prob", 9))


def err_counts_single(spark, sf):
    return errmodel.single_edit_counts(errmodel.word_pairs(log(spark, sf)))


def err_cost_single(spark, sf):
    return errmodel.edit_costs(err_counts_single(spark, sf)).withColumn("cost", F.round("cost", 9))


def err_context(spark, sf):
    return errmodel.seen_contexts(errmodel.word_pairs(log(spark, sf)))


def err_counts_all(spark, sf):
    return errmodel.edit_counts(errmodel.word_pairs(log(spark, sf)))


def err_probability(spark, sf):
    pairs = errmodel.word_pairs(log(spark, sf))
    return errmodel.edit_probability(pairs, errmodel.edit_costs(errmodel.edit_counts(pairs))).withColumn("prob", F.round("prob", 9))


def nodes(spark, sf):
    return table(spark, "trie", sf, lambda: trie.trie(unigrams(spark, sf)))


def trie_prefix(spark, sf):
    return nodes(spark, sf).select("prefix", "parent", "edge", "depth", "cnt")


def trie_topk_children(spark, sf):
    return trie.top_children(nodes(spark, sf), unigrams(spark, sf), facts(spark, sf))


def trie_lookup(spark, sf):
    words = log(spark, sf).filter("wrong is not null").select(F.explode(text.query_words(F.col("wrong"))).alias("word")).distinct()
    return words.join(nodes(spark, sf).select(F.col("prefix").alias("word"), "cnt"), "word", "left").select("word", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def layout_swap(spark, sf):
    s = layout.swap(F.col("text"))
    return typed(spark, sf).select("qid", s.getField("text").alias("swapped"), s.getField("changed").alias("changed"), s.getField("lang").cast("long").alias("lang"))


def script_detect(spark, sf):
    t = F.col("text")
    return typed(spark, sf).select("qid", layout.is_english(t).alias("english"), layout.is_russian(t).alias("russian"))


def layout_vocab(spark, sf):
    w = unigrams(spark, sf).select("word")
    return w.select("word", layout.to_cyrillic(F.col("word")).alias("swapped")).distinct()


def layout_known(spark, sf):
    """Typed queries that are a right one in the other layout."""
    right = log(spark, sf).select(F.col("right").alias("swapped")).distinct()
    return layout_swap(spark, sf).filter("changed").select("qid", "swapped").join(right, "swapped", "left_semi").select("qid", "swapped")


def layout_score(spark, sf):
    words = unigrams(spark, sf).select(layout.to_latin(layout.to_cyrillic(F.col("word"))).alias("word")).union(trie_lookup(spark, sf).select("word")).distinct()
    return trie.layout_score(words, nodes(spark, sf), unigrams(spark, sf), facts(spark, sf)).withColumn("score", F.round("score", 6))


def typed_words(spark, sf):
    return typed(spark, sf).select("qid", F.posexplode(text.query_words(F.col("text"))).alias("pos", "word"))


def halves(spark, sf):
    """Log words cut in two, so that neighbours join to known words."""
    w = unigrams(spark, sf).filter(F.length("word") >= 2).select(F.xxhash64("word").alias("qid"), "word")
    cut = F.floor(F.length("word") / 2).cast("int")
    return w.select("qid", F.posexplode(F.array(F.substring("word", F.lit(1), cut), F.substring("word", cut + 1, F.length("word")))).alias("pos", "word"))


def join_candidates(spark, sf):
    return trie.join_candidates(halves(spark, sf), unigrams(spark, sf), facts(spark, sf)).groupBy("joined").agg(F.count("*").alias("n"))


def join_score(spark, sf):
    return trie.join_candidates(halves(spark, sf), unigrams(spark, sf), facts(spark, sf)).select("joined", F.round("score", 6).alias("score")).distinct()


def argmax_tiebreak(spark, sf):
    """For each first word of a bigram the next word of largest share; of equal ones the commoner, then the lesser."""
    best = bigrams(spark, sf).join(unigrams(spark, sf).select(F.col("word").alias("w2"), F.col("cnt").alias("c2")), "w2")
    w = Window.partitionBy("w1").orderBy(F.desc(F.round("p", 9)), F.desc("c2"), "w2")
    return best.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("w1", "w2")


def lookahead_score(spark, sf):
    """For each word, the best probability of it and a next word."""
    return bigrams(spark, sf).join(unigrams(spark, sf).select(F.col("word").alias("w2"), F.col("p").alias("p1")), "w2").groupBy("w1").agg(F.round(F.max(F.col("p") * F.col("p1")), 9).alias("score"))


def typed_candidates(spark, sf):
    """Two candidates for each typed word: itself and its reverse."""
    both = F.array(F.struct(F.lit(0).alias("idx"), F.col("word").alias("word")), F.struct(F.lit(1).alias("idx"), F.reverse("word").alias("word")))
    return typed_words(spark, sf).select("qid", "pos", F.explode(both).alias("x")).select("qid", "pos", "x.idx", "x.word")


def lookahead_candidates(spark, sf):
    """Each candidate's best probability with a candidate of the next word."""
    found = lm.lookahead(typed_candidates(spark, sf), unigrams(spark, sf), bigrams(spark, sf), facts(spark, sf))
    return found.select("qid", "pos", "idx", "word", F.round("score", 12).alias("score"))


def argmax_candidates(spark, sf):
    """For each first letter of a first word the best next word by share of its bigram; ties by its own share, then the earlier."""
    b = bigrams(spark, sf).select(F.substring("w1", 1, 1).alias("letter"), F.concat_ws(" ", "w2").alias("text"), F.round("p", 6).alias("score"), F.row_number().over(Window.orderBy("w2", "w1")).alias("idx"))
    return lm.argmax(b, unigrams(spark, sf), facts(spark, sf), ["letter"])


def trie_inserts(spark, sf):
    pairs = errmodel.word_pairs(log(spark, sf))
    found = trie.cheapest_inserts(nodes(spark, sf), errmodel.edit_costs(errmodel.edit_counts(pairs)), errmodel.seen_contexts(pairs))
    return found.withColumn("cost", F.round("cost", 9))


def layout_vocabularies(spark, sf):
    """What typed words of either script are in the other layout, both ways."""
    return layout.vocabularies(typed_words(spark, sf).select("word").distinct())


def fuzzy_lev1_candidates(spark, sf):
    words = trie_lookup(spark, sf).select("word")
    return trie.close_words(words, unigrams(spark, sf).select("word"))


def fuzzy_lev2_candidates(spark, sf):
    words = trie_lookup(spark, sf).select("word")
    return trie.close_words(words, unigrams(spark, sf).select("word"), distance=2)


def recover_case(spark, sf):
    p = read(spark, sf, "part")
    cased = F.initcap("p_name")
    return p.select("p_partkey", text.restore_case(cased, F.reverse("p_name")).alias("restored"))


def recover_separators(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.concat(F.initcap(F.split("p_name", " ")[0]), F.lit(", "), F.split("p_name", " ")[1], F.lit("!")).alias("q"))
    return p.select("p_partkey", text.restore_separators(F.lower("q"), text.query_words(F.col("q")), text.separators(F.col("q")), text.query_words_cased(F.col("q"))).alias("restored"))


def recover_whole_names(spark, sf):
    """Whole names, typed with commas, capitals and an end, from their words alone."""
    typed = F.concat(F.array_join(F.transform(F.split("p_name", " "), F.initcap), ", "), F.lit("!"))
    p = read(spark, sf, "part").select("p_partkey", typed.alias("q"))
    return p.select("p_partkey", text.restore_separators(F.lower("q"), text.query_words(F.col("q")), text.separators(F.col("q")), text.query_words_cased(F.col("q"))).alias("restored"))


def non_words(spark, sf):
    seps = text.separators(F.col("text"))
    return documents(spark, sf).select("doc_id", F.size(seps).cast("long").alias("n"), F.array_join(seps, "|").alias("joined"))


def fuzzy_search(spark, sf):
    words = trie_lookup(spark, sf).select(F.col("word").alias("text"))
    return correct.search_words(spark, words, models(spark, sf, gated=False).collected())


def fuzzy_joined(spark, sf):
    """Candidates by joins, for vocabularies beyond the search's bound."""
    words = trie_lookup(spark, sf).select(F.col("word").alias("text"))
    return correct.joined_candidates(words, unigrams(spark, sf), nodes(spark, sf), facts(spark, sf)).withColumn("score", F.round("score", 6))


def correct_query(spark, sf):
    return correct.correct_queries(spark, typed(spark, sf), models(spark, sf).collected())


def labelled_features(spark, sf):
    rows = querylog.labelled(log(spark, sf)).withColumn("qid", F.xxhash64("qid", "need_fix"))
    return lm.features(rows, unigrams(spark, sf), bigrams(spark, sf), facts(spark, sf))


def trained_gate(spark, sf):
    """The gate, trained once for each source folder; ROUNDS rounds here, 150 by default."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _gates:
        _gates[key] = gate.train(labelled_features(spark, sf), ROUNDS)
    return _gates[key]


def gate_predict(spark, sf):
    return gate.predict(trained_gate(spark, sf), feature_table(spark, sf))


def models(spark, sf, gated: bool = True):
    pairs = errmodel.word_pairs(log(spark, sf))
    costs = errmodel.edit_costs(errmodel.edit_counts(pairs))
    return saved.Models(unigrams(spark, sf), bigrams(spark, sf), costs, errmodel.seen_contexts(pairs), nodes(spark, sf), trained_gate(spark, sf) if gated else None)


def models_reload(spark, sf):
    """The bigrams of a model folder, written here and opened anew."""
    folder = shared_dir(spark, "models")
    saved.save_models(models(spark, sf, gated=False), folder)
    return saved.load_models(spark, folder).bigrams.select("w1", "w2", "cnt", F.round("p", 12).alias("p"))


def tfidf_svd(spark, sf):
    return gate.svd(gate.tfidf(typed(spark, sf))[1])


def _written(spark, label, name, data: str | bytes) -> str:
    """A small input file in the shared folder."""
    path = shared_dir(spark, label)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(data if isinstance(data, bytes) else data.encode()))
    out.close()
    return path


def stream_bool(spark, sf):
    """Lines of a file, one of them empty and one repeated; each is answered by its number."""
    folder = _written(spark, "stream-in", "q.txt", "\n".join([*STREAM, ""]))
    out = shared_dir(spark, "stream-out")
    stream.search_stream(spark, folder, out, shared_dir(spark, "stream-state"), postings(spark, sf), ids(spark, sf))
    return spark.read.parquet(out).select("line", "query", "doc_id", F.col("error").isNull().alias("answered"))


def crawl_source(spark, sf):
    """An archive of a few records through the crawl source."""
    return crawl.read_crawl(spark, [_written(spark, "crawl", "a.gz", crawl.write_records(CRAWL))]).select("doc_id", "url", "text")


def crawl_paths(spark, sf):
    """An archive, a folder and the archive again: records count as often as their path is given, in that order."""
    one = _written(spark, "crawl", "a.gz", crawl.write_records(CRAWL)) + "/a.gz"
    two = _written(spark, "crawl", "b.gz", crawl.write_records(CRAWL[::-1]))
    return crawl.read_crawl(spark, [one, two, one]).select("doc_id", "url", "text")


PLAIN = [
    index_reload, simple9_index, search_saved, models_reload, result_lines, log_lines, log_lines_labelled, log_lines_pairs, lookahead_candidates, argmax_candidates, trie_inserts, layout_vocabularies, fuzzy_lev2_candidates, fuzzy_joined, recover_whole_names, crawl_paths,
    bool_setops, bool_arrays, bool_scan, bool_batch, bool_errors, idx_postings, idx_df, idx_dict_size, tok_count_per_doc, simple9_roundtrip, url_extract, text_clean, url_lines,
    result_urls, result_counts, log_columns, log_labelled, lm_unigram, lm_bigram, lm_smooth, lm_query_prob, features, err_counts_single, err_cost_single, err_context, err_counts_all,
    err_probability, trie_prefix, trie_topk_children, trie_lookup, layout_swap, script_detect, layout_vocab, layout_known, layout_score, join_candidates, join_score, argmax_tiebreak,
    lookahead_score, fuzzy_lev1_candidates, recover_case, recover_separators, non_words, fuzzy_search, correct_query, gate_predict, tfidf_svd, stream_bool, crawl_source,
]
QUERIES = {name: partial(_flags, q) for name, q in BOOLEAN.items()} | {f.__name__: f for f in PLAIN}

W, P = r"'[\p{L}\p{N}_]+'", r"'[\p{L}\p{N}]+'"
TOKENS = f"tok as (select doc_id, regexp_extract_all(lower(text), {W}) ts from documents)"
POSTINGS = f"post as (select distinct doc_id, unnest(regexp_extract_all(lower(text), {W})) term from documents)"


def _predicate_sql(query: str) -> str:
    def go(x):
        if isinstance(x, boolean.Term):
            return f"list_contains(ts, '{x.word}')"
        if isinstance(x, boolean.Not):
            return f"(not {go(x.x)})"
        return f"({go(x.l)} {'and' if isinstance(x, boolean.And) else 'or'} {go(x.r)})"

    return go(boolean.parse(query))


def _bool_sql(query: str) -> str:
    return f"with {TOKENS} select doc_id from tok where {_predicate_sql(query)}"


def _valid(q: str) -> bool:
    try:
        return bool(boolean.parse(q))
    except boolean.QueryError:
        return False


WORDS = f"words as (select p_partkey qid, regexp_extract_all(lower(p_name), {P}) ws from part)"
UNI = "uni as (select word, count(*) cnt, count(*) / sum(count(*)) over () p from (select unnest(ws) word from words) group by word)"
N = "n as (select sum(cnt)::bigint n_tokens from uni)"
BI = "bic as (select w1, w2, count(*) cnt from (select ws[i] w1, ws[i + 1] w2 from (select ws, unnest(range(1, len(ws))) i from words)) group by 1, 2), bi as (select w1, w2, b.cnt, b.cnt / u.cnt p from bic b join uni u on u.word = b.w2)"
LM = ", ".join((WORDS, UNI, N, BI))
TYPED = f"{LOG_SQL}, typed as (select qid, coalesce(wrong, right_q) as text from log), tw as (select qid, regexp_extract_all(lower(text), {P}) ws, text from typed)"
PROB = """long as (select qid, ws[i] w1, ws[i + 1] w2 from (select qid, ws, unnest(range(1, len(ws) + 1)) i from tw)),
prob as (select long.qid, product(coalesce(case when long.w2 is null then u.p else b.p end, 1.0 / n_tokens)) prob
  from long cross join n left join bi b on b.w1 = long.w1 and b.w2 = long.w2 left join uni u on u.word = long.w1 group by long.qid)"""
PAIRS = f"""lw as (select regexp_extract_all(lower(right_q), {P}) a, regexp_extract_all(lower(wrong), {P}) b from log where wrong is not null),
pairs as (select a[i] r, b[i] w from (select a, b, unnest(range(1, len(a) + 1)) i from lw where len(a) = len(b)))"""
EDITS = """one as (select r, w, len(list_filter(range(1, least(length(r), length(w)) + 1), lambda i: substr(r, 1, i) = substr(w, 1, i))) l from pairs where levenshtein(r, w) = 1),
pc as (select *, case when l = 0 then '^' else substr(r, l, 1) end c from one),
err as (select case when length(w) > length(r) then c || '_' else c || substr(r, l + 1, 1) end ctx,
  case when length(w) < length(r) then c || '_' else c || substr(w, l + 1, 1) end tgt, count(*) + 1 cnt from pc group by 1, 2)"""
#: Pairs that need one edit, or have no character in common: every character replaced. The log makes no others.
EDITS_ALL = EDITS.replace("err as (select", "ones as (select").replace("count(*) + 1 cnt from pc group by 1, 2)", """1 cnt from pc),
apart as (select r, w, unnest(range(1, length(r) + 1)) i from pairs where length(r) = length(w) and levenshtein(r, w) > 1 and len(list_intersect(string_split(r, ''), string_split(w, ''))) = 0),
every as (select r, w, ctx, tgt from (select r, w, case when length(w) > length(r) then c || '_' else c || substr(r, l + 1, 1) end ctx,
  case when length(w) < length(r) then c || '_' else c || substr(w, l + 1, 1) end tgt from pc)
  union all select r, w, p || substr(r, i, 1), p || substr(w, i, 1) from (select r, w, i, case when i = 1 then '^' else substr(r, i - 1, 1) end p from apart)),
err as (select ctx, tgt, count(*) + 1 cnt from every group by 1, 2),
cost as (select ctx, tgt, case when ctx = tgt then 0 else 1 - cnt / sum(cnt) over (partition by ctx) end::double cost from err)""")
LINES = r"""ls as (select p_partkey, case p_partkey % 3 when 0 then [p_name] when 1 then [p_brand, p_name] else [p_type, p_name, p_brand] end cols from part),
parsed as (select case when len(cols) > 1 then cols[1] end wrong, case len(cols) when 1 then cols[1] else cols[2] end right_q, len(cols)::int ncols from ls)"""
TRIE = "trie as (select prefix, sum(cnt)::bigint cnt from (select substr(word, 1, i) prefix, cnt from (select word, cnt, unnest(range(1, length(word) + 1)) i from uni)) group by 1)"
LOOKUP = f"lookup as (select distinct unnest(regexp_extract_all(lower(wrong), {P})) word from log where wrong is not null)"
SCORE = "0.025 * log2({c}) - {cost} * log2(1.2) + 25 * log2(1 + {p})"
EN, RU = sql_literal(layout.LATIN), sql_literal(layout.CYRILLIC)
SCRIPT = f"""len(list_filter(regexp_extract_all(lower(text), {W}), lambda t: regexp_matches(t, '^[a-z0-9_]+$'))) > 0 english,
  len(list_filter(regexp_extract_all(text, {W}), lambda t: regexp_matches(t, '^[а-я0-9_]+$'))) > 0 russian"""
SWAP = f"sw as (select qid, text, {SCRIPT} from typed), swapped as (select qid, case when english then translate(text, {EN}, {RU}) when russian then translate(text, {RU}, {EN}) else text end swapped, english or russian as changed, (case when english then 0 when russian then 1 end)::bigint lang from sw)"
S = r"'[^\p{L}\p{N}_]+'"

ORACLE_SQL = {name: _bool_sql(q) for name, q in BOOLEAN.items()} | {
    "bool_setops": _bool_sql(FLAGSHIP),
    "bool_arrays": _bool_sql(FLAGSHIP),
    "bool_scan": _bool_sql(FLAGSHIP),
    "bool_batch": f"with {TOKENS} " + " union all ".join(f"select {i}::bigint qid, doc_id from tok where {_predicate_sql(q)}" for i, q in enumerate(BATCH) if _valid(q)),
    "bool_errors": " union all ".join(f"select {i}::bigint qid" for i, q in enumerate(BATCH) if not _valid(q)),
    "idx_postings": f"with {POSTINGS} select term, doc_id from post",
    "simple9_roundtrip": f"with {POSTINGS} select term, doc_id from post",
    "index_reload": f"with {POSTINGS} select term, doc_id from post",
    "simple9_index": f"with {POSTINGS} select term, doc_id from post",
    "search_saved": f"with {TOKENS} select t.doc_id, p.url from tok t left join pages p on p.page_id = t.doc_id where {_predicate_sql(FLAGSHIP)}",
    "models_reload": f"with {LM} select w1, w2, (select count(*) from words, unnest(range(1, len(ws))) u(i) where ws[i] = w1 and ws[i + 1] = w2) cnt, round(p, 12) p from bi",
    "result_lines": f"with {TOKENS}, hit as (select doc_id from tok where {_predicate_sql('the&and')}) select -1::bigint place, count(*)::varchar line from hit union all select h.doc_id, coalesce(p.url, '') from hit h left join pages p on p.page_id = h.doc_id",
    "log_lines": f'with {LINES} select wrong, right_q as "right", ncols, count(*) n from parsed group by 1, 2, 3',
    "log_lines_labelled": f"with {LINES} select text, need_fix, count(*) n from (select lower(wrong) as text, 1::int need_fix from parsed where ncols = 2 union all select lower(right_q), 0::int from parsed where ncols < 3 union all select lower(wrong), 0::int from parsed where ncols = 3) group by 1, 2",
    "log_lines_pairs": f'with {LINES}, ws as (select regexp_extract_all(lower(right_q), {P}) a, regexp_extract_all(lower(wrong), {P}) b from parsed where ncols = 2) select a[i] as "right", b[i] wrong, count(*) n from (select a, b, unnest(range(1, len(a) + 1)) i from ws where len(a) = len(b)) group by 1, 2',
    "lookahead_candidates": f"""with {LM}, {TYPED}, own as (select qid, unnest(range(1, len(ws) + 1)) - 1 pos, unnest(ws) word from tw), cand as (select qid, pos, 0 idx, word from own union all select qid, pos, 1, reverse(word) from own)
      select a.qid, a.pos::int pos, a.idx::int idx, a.word, round(max(coalesce(bi.p, 1.0 / n_tokens) * coalesce(uni.p, 1.0 / n_tokens)), 12) score
      from cand a join cand b on b.qid = a.qid and b.pos = a.pos + 1 cross join n left join bi on w1 = a.word and w2 = b.word left join uni on uni.word = b.word group by 1, 2, 3, 4""",
    "argmax_candidates": f"with {LM} select letter, text from (select w1[1] letter, w2 as text, row_number() over (partition by w1[1] order by round(bi.p, 6) desc, uni.p desc, w2, w1) rn from bi join uni on uni.word = w2) where rn = 1",
    "trie_inserts": f"""with {LM}, {TRIE}, {LOG_SQL}, {PAIRS}, {EDITS_ALL}, kids as (select prefix, substr(prefix, 1, length(prefix) - 1) parent, case when length(prefix) = 1 then '^' || prefix else right(prefix, 2) end edge from trie),
      priced as (select parent, prefix, edge, coalesce(cost.cost, 1) cost from kids left join cost on ctx = edge[1] || '_' and tgt = edge)
      select parent, prefix, round(cost, 9)::double cost, rank from (select *, row_number() over (partition by parent order by cost, edge) as rank from priced) where rank <= 6""",
    "layout_vocabularies": f"""with {TYPED}, each as (select distinct unnest(ws) word from tw), sc as (select word, regexp_full_match(word, '[a-z0-9_]+') english, regexp_full_match(word, '[а-я0-9_]+') russian from each),
      one as (select word, case when english then translate(word, {EN}, {RU}) else translate(word, {RU}, {EN}) end other, english from sc where english or russian)
      select word typed, other meant, english to_cyrillic from one union select other, word, not english from one""",
    "fuzzy_lev2_candidates": f"with {LM}, {LOG_SQL}, {LOOKUP} select lookup.word typed, uni.word from lookup join uni on levenshtein(lookup.word, uni.word) <= 2",
    "fuzzy_joined": f"""with {LM}, {TRIE}, {LOG_SQL}, {LOOKUP}, rated as (select l.word typed, u.word, {SCORE.format(c='trie.cnt', cost='levenshtein(l.word, u.word)', p='u.p')} s
        from lookup l join uni u on levenshtein(l.word, u.word) <= 2 join trie on prefix = u.word where length(l.word) between 4 and 10),
      best as (select typed, word, s, row_number() over (partition by typed order by round(s, 9) desc, word)::int rank from rated)
      select l.word as text, coalesce(b.rank, 1)::int as rank, coalesce(b.word, l.word) candidate, round(coalesce(b.s, 0), 6) score from lookup l left join best b on b.typed = l.word and b.rank <= 3""",
    "recover_whole_names": "select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ', ') || '!' restored from part",
    "err_counts_all": f"with {LOG_SQL}, {PAIRS}, {EDITS_ALL} select ctx, tgt, cnt from err",
    "err_probability": f"""with {LOG_SQL}, {PAIRS}, {EDITS_ALL}, total as (select r, w, sum(coalesce(cost.cost, 1)) s from (select distinct * from (select r, w, ctx, tgt, row_number() over (partition by r, w, ctx, tgt) k from every)) e left join cost using (ctx, tgt) where k <= 1 group by r, w)
      select d.r as "right", d.w wrong, round(power(1.2, -case when coalesce(s, 0) = 0 then 1 else s end), 9) prob from (select distinct r, w from pairs) d left join total using (r, w)""",
    "stream_bool": f"with {TOKENS} " + " union all ".join(f"select {i}::int line, {sql_literal(q)} query, doc_id, true answered from tok where {_predicate_sql(q)}" if _valid(q) else f"select {i}::int, {sql_literal(q)}, null::bigint, false" for i, q in enumerate(STREAM) if q),
    "crawl_source": "select * from (values " + ", ".join(f"({i}::bigint, 'http://example.org/{i} end', 'text {i} line')" for i in range(5)) + ", (5, null, 'x'), (6, 'http://example.org/short', '')) t(doc_id, url, text)",
    "crawl_paths": "select * from (values " + ", ".join(f"({at + (6 - i if flip else i)}::bigint, {u}, {t})" for at, flip in ((0, False), (7, True), (14, False)) for i, (u, t) in enumerate([*((f"'http://example.org/{i} end'", f"'text {i} line'") for i in range(5)), ("null", "'x'"), ("'http://example.org/short'", "''")])) + ") t(doc_id, url, text)",
    "idx_df": f"with {POSTINGS} select term, count(*) df from post group by term",
    "idx_dict_size": f"with {POSTINGS} select count(distinct term) n_terms, count(*) n_postings from post",
    "tok_count_per_doc": f"with {TOKENS} select doc_id, len(ts)::bigint n_tokens, len(list_distinct(ts))::bigint n_terms from tok",
    "url_extract": r"select page_id, nullif(regexp_extract(url, '(?s)http:.*\b', 0), '') url_found from pages",
    "text_clean": "select page_id, replace(substr(replace(html, chr(160), ' '), 2), chr(10), ' ') clean from pages",
    "url_lines": "select page_id, url || '/' line from pages",
    "result_urls": f"with {TOKENS} select t.doc_id, p.url from tok t left join pages p on p.page_id = t.doc_id where {_predicate_sql('the&and')}",
    "result_counts": f"with {TOKENS} select count(*) n from tok where {_predicate_sql('the&and')}",
    "log_columns": f'with {LOG_SQL} select qid, wrong, right_q as "right", case when wrong is null then 1 else 2 end::int ncols from log',
    "log_labelled": f"with {LOG_SQL} select qid, lower(wrong) as text, 1::int need_fix from log where wrong is not null union all select qid, lower(right_q), 0::int from log",
    "lm_unigram": f"with {LM} select word, cnt, round(p, 12) p from uni",
    "lm_bigram": f"with {LM} select w1, w2, cnt, round(p, 12) p from bi",
    "lm_smooth": f"with {LM} select n_tokens, round(1.0 / n_tokens, 12) smooth from n",
    "lm_query_prob": f"with {LM}, {TYPED}, {PROB} select t.qid, round(coalesce(prob, 0), 9) prob from tw t left join prob using (qid)",
    "features": f"""with {LM}, {TYPED}, {PROB}, known as (select qid, count(*) c from (select qid, unnest(ws) w from tw) join uni on uni.word = w and uni.cnt >= 2 group by qid)
      select t.qid, round(coalesce(prob, 0), 9) prob, length(text)::bigint n_chars, len(ws)::bigint n_words, length(regexp_replace(text, {W}, '', 'g'))::bigint n_other, coalesce(c, 0)::bigint n_known
      from tw t left join prob using (qid) left join known using (qid)""",
    "err_counts_single": f"with {LOG_SQL}, {PAIRS}, {EDITS} select ctx, tgt, cnt from err",
    "err_cost_single": f"with {LOG_SQL}, {PAIRS}, {EDITS} select ctx, tgt, round(case when ctx = tgt then 0 else 1 - cnt / sum(cnt) over (partition by ctx) end, 9)::double cost from err",
    "err_context": f"with {LOG_SQL}, {PAIRS} select case when i = 1 then '^' else substr(r, i - 1, 1) end || substr(r, i, 1) ctx, count(*) total from (select r, unnest(range(1, length(r) + 1)) i from pairs) group by 1",
    "trie_prefix": f"with {LM}, {TRIE} select prefix, substr(prefix, 1, length(prefix) - 1) parent, case when length(prefix) = 1 then '^' || prefix else right(prefix, 2) end edge, length(prefix)::bigint depth, cnt from trie",
    "trie_topk_children": f"""with {LM}, {TRIE}, kids as (select prefix, substr(prefix, 1, length(prefix) - 1) parent, case when length(prefix) = 1 then '^' || prefix else right(prefix, 2) end edge,
      round({SCORE.format(c='trie.cnt', cost='0', p='coalesce(uni.p, 1.0 / n_tokens)')}, 9) s from trie cross join n left join uni on uni.word = prefix)
      select parent, prefix, rank from (select parent, prefix, row_number() over (partition by parent order by s desc, edge desc) as rank from kids) where rank <= 6""",
    "trie_lookup": f"with {LM}, {TRIE}, {LOG_SQL}, {LOOKUP} select word, coalesce(cnt, 0)::bigint cnt from lookup left join trie on prefix = word",
    "script_detect": f"with {TYPED} select qid, {SCRIPT} from typed",
    "layout_swap": f"with {TYPED}, {SWAP} select qid, swapped, changed, lang from swapped",
    "layout_known": f"with {TYPED}, {SWAP} select qid, swapped from swapped where changed and swapped in (select right_q from log)",
    "layout_vocab": f"with {LM} select word, translate(word, {EN}, {RU}) swapped from uni",
    "layout_score": f"""with {LM}, {TRIE}, {LOG_SQL}, {LOOKUP}, ws as (select word from uni union select word from lookup)
      select ws.word, round(case when ws.word = '' then -1000 when trie.cnt is null then {SCORE.format(c='1', cost='0.7', p='coalesce(uni.p, 1.0 / n_tokens)')} else {SCORE.format(c='trie.cnt', cost='0', p='coalesce(uni.p, 1.0 / n_tokens)')} end, 6) score
      from ws cross join n left join trie on prefix = ws.word left join uni on uni.word = ws.word""",
    "join_candidates": f"with {LM} select word joined, 1::bigint n from uni where cnt >= 2 and length(word) >= 2",
    "join_score": f"with {LM} select word joined, round(p * 100000, 6) score from uni where cnt >= 2 and length(word) >= 2",
    "argmax_tiebreak": f"with {LM} select w1, w2 from (select w1, w2, row_number() over (partition by w1 order by round(bi.p, 9) desc, uni.cnt desc, w2) rn from bi join uni on uni.word = w2) where rn = 1",
    "lookahead_score": f"with {LM} select w1, round(max(bi.p * uni.p), 9) score from bi join uni on uni.word = w2 group by w1",
    "fuzzy_lev1_candidates": f"with {LM}, {LOG_SQL}, {LOOKUP} select lookup.word typed, uni.word from lookup join uni on levenshtein(lookup.word, uni.word) <= 1",
    "recover_case": """select p_partkey, array_to_string(list_transform(range(1, length(p_name) + 1), lambda i:
      case when (i = 1 or substr(p_name, i - 1, 1) = ' ') and substr(p_name, i, 1) <> ' ' then upper(substr(reverse(p_name), i, 1)) else substr(reverse(p_name), i, 1) end), '') restored from part""",
    "recover_separators": "select p_partkey, upper(substr(a, 1, 1)) || substr(a, 2) || ', ' || b || '!' restored from (select p_partkey, string_split(p_name, ' ')[1] a, string_split(p_name, ' ')[2] b from part)",
    "non_words": f"select doc_id, len(regexp_extract_all(text, {S}))::bigint n, array_to_string(regexp_extract_all(text, {S}), '|') joined from documents",
}
