"""The document-search queries by name, each with DuckDB SQL over the same tables where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprint, meta
from .. import scratch
from ..functions.score import proximity_score
from ..functions.text import WS, contextual_snippet, file_name, file_stem, snippet, words
from ..operators import postings as post
from ..operators.search import Engine, hamming_pairs, lsh_clusters, lsh_sets, scan_candidates, word_trigrams
from ..sources import corpus, files
from ..sources.kinds import kind, language
from .index import Index
from .output import render

SEARCH = "ation ouer nder"
WORD = "tion"
TITLED = "letter 4217"
SPAN = (b"the", b"ing")

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark, sf):
    return Engine(corpus.documents(spark, sf), corpus.AS_OF)


def _letters(spark, sf):
    return Engine(corpus.invoices(spark, sf), corpus.AS_OF)


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("path", F.round("score", 6).alias("score"))


def normalize_text(spark, sf):
    return corpus.documents(spark, sf).select("doc_id", F.md5("norm").alias("norm_md5"), F.length("norm").cast("long").alias("n"))


def word_tokens(spark, sf):
    w = words(F.col("text"))
    return corpus.documents(spark, sf).select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


def snippets(spark, sf):
    return corpus.documents(spark, sf).select("doc_id", F.md5(snippet(F.col("text"))).alias("snippet_md5"))


def doc_trigram_count(spark, sf):
    return post.counts(corpus.documents(spark, sf))


def _hex(trigram):
    return F.lpad(F.hex(trigram), 6, "0")


def trigram_postings(spark, sf):
    built = post.build(corpus.documents(spark, sf))
    return built.select(_hex("trigram").alias("trigram"), "doc_id", F.col("tf").cast("long").alias("tf"), F.array_min("positions").cast("long").alias("first"), F.array_max("positions").cast("long").alias("last"))


def trigram_df_topk(spark, sf):
    counted = post.document_frequencies(post.build(corpus.documents(spark, sf)))
    return counted.orderBy(F.desc("df"), F.desc("tf"), "trigram").limit(50).select(_hex("trigram").alias("trigram"), "df", "tf")


def trigram_candidates_one_word(spark, sf):
    return scan_candidates(corpus.documents(spark, sf), WORD).select("doc_id")


def trigram_candidates_multi_word(spark, sf):
    return post.candidates(post.build(corpus.documents(spark, sf)), word_trigrams(SEARCH))


def search_score_topk(spark, sf):
    return _rounded(_docs(spark, sf).search(SEARCH, 20))


def search_index_topk(spark, sf):
    """Over stored postings: candidates and frequencies are two reads of the query's trigrams."""
    docs, path = corpus.documents(spark, sf), scratch.folder(spark, "postings")
    post.write(post.build(docs), path)
    return _rounded(Engine(docs, corpus.AS_OF, spark.read.schema(post.SCHEMA).parquet(path)).search(SEARCH, 20))


def search_title_boost(spark, sf):
    return _rounded(_letters(spark, sf).search(TITLED, 20))


def contextual_snippets(spark, sf):
    docs = corpus.documents(spark, sf)
    return docs.select("doc_id", F.md5(contextual_snippet(F.col("text"), f"zz {WORD} ation", F.lit("none"), 40)).alias("snippet_md5"))


def min_span_pair(spark, sf):
    return post.min_span_of_postings(post.build(corpus.documents(spark, sf)), list(SPAN)).select("doc_id", F.col("span").cast("long").alias("span"))


def meta_doc_type(spark, sf):
    return corpus.invoices(spark, sf).groupBy(F.coalesce("doc_type", F.lit("-")).alias("doc_type")).agg(F.count("*").alias("n"))


def meta_dates(spark, sf):
    return corpus.invoices(spark, sf).select("doc_id", F.explode("dates").alias("d")).select("doc_id", F.date_format("d", "yyyy-MM-dd").alias("d"))


def meta_amounts(spark, sf):
    return corpus.invoices(spark, sf).select("doc_id", F.explode("amounts").alias("amount"))


def meta_emails(spark, sf):
    return corpus.invoices(spark, sf).select("doc_id", F.explode("emails").alias("email"))


def meta_entities(spark, sf):
    return corpus.invoices(spark, sf).select("doc_id", F.explode("entities").alias("entity"))


def _query(expression: str, docs=_letters) -> Query:
    return lambda spark, sf: _rounded(docs(spark, sf).query(expression, 25))


def recent_topk(spark, sf):
    return _rounded(_docs(spark, sf).recent("60d", 20))


def _fingerprinted(spark, sf):
    """Documents with their SimHash, stored, as an index has them: no request computes it again."""
    return scratch.stored(corpus.documents(spark, sf).select("doc_id", "path", "doc_type", "simhash"), "fingerprints")


def lsh_bands(spark, sf):
    return _fingerprinted(spark, sf).select("doc_id", F.explode(fingerprint.bands(F.col("simhash"), 8)).alias("b")).select("doc_id", F.col("b.band").cast("long").alias("band"), "b.value")


def lsh_cluster_sets(spark, sf):
    return lsh_sets(_fingerprinted(spark, sf), 4)[1].select("size", "first", "last")


def lsh_cluster_members(spark, sf):
    """How many sets of each size a document is in."""
    return lsh_clusters(_fingerprinted(spark, sf), 4).groupBy(F.col("id").alias("doc_id"), "size").agg(F.count("*").alias("n"))


def hamming_near(spark, sf):
    return hamming_pairs(_fingerprinted(spark, sf), 4, 3).select("a", "b", F.col("distance").cast("long").alias("distance"), "n_a", "n_b")


def simhash_fingerprint(spark, sf):
    return corpus.documents(spark, sf).select("doc_id", "simhash")


def similar_topk(spark, sf):
    return _rounded(Engine(_fingerprinted(spark, sf), corpus.AS_OF).similar("/corpus/src0/doc_0.txt", limit=20))


def clusters_docs(spark, sf):
    return Engine(_fingerprinted(spark, sf), corpus.AS_OF).clusters(4).select("size", F.array_join("members", ",").alias("members"), "more")


def _two_states(spark, sf, postings=False):
    """An index of all documents, and the files of a later walk with their contents.

    Until then the German documents have moved to another folder, the long ones got a line and a new time, the
    Spanish ones only a new time, and the French ones can't be parsed any more, those with a new time among them.
    """
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").withColumn("lang", F.coalesce("lang", F.lit("-")))
    long = F.col("n_chars") > 2000

    def state(folder, text, mtime, error):
        path = F.concat(folder, "source", F.lit("/doc_"), "doc_id", F.lit(".txt"))
        columns = docs.select(path.alias("path"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("language"), mtime.alias("mtime"), F.octet_length(text).cast("long").alias("size"), text.alias("text"), error.alias("error"))
        walked = columns.select("path", "kind", "language", "mtime", "size")
        ok = F.col("error").isNull()
        read = columns.select("path", fingerprint.xxh64(F.col("text")).alias("file_hash"), F.when(ok, F.col("text")).alias("text"), F.lit(None).cast("string").alias("title"), "error")
        return walked, read

    before, after = corpus.mtime_of(F.col("doc_id")), F.lit(corpus.AS_OF)
    index = Index(spark, scratch.folder(spark, "index"), with_postings=postings)
    walked, read = state(F.lit("/corpus/"), F.col("text"), before, F.lit(None).cast("string"))
    index.apply(walked, index.diff(walked, "/corpus"), read)
    moved = F.when(F.col("lang") == "de", "/corpus/moved/").otherwise("/corpus/")
    later = state(moved, F.when(long, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text")), F.when(long | (F.col("lang") == "es"), after).otherwise(before), F.when(F.col("lang") == "fr", "ParseError"))
    return index, *later


def index_diff_status(spark, sf):
    """What an update finds out from paths and times alone."""
    index, walked, _ = _two_states(spark, sf)
    return index.diff(walked, "/corpus").groupBy("status").agg(F.count("*").alias("n"))


def index_update_stats(spark, sf):
    """The counts of the second update."""
    index, walked, read = _two_states(spark, sf)
    diff = index.diff(walked, "/corpus")
    stats = index.apply(walked, diff, read.join(diff.where("status in ('new', 'changed')").select("path"), "path", "left_semi"))
    return spark.createDataFrame([(stats.added, stats.skipped, stats.removed, stats.errors)], "added long, skipped long, removed long, errors long")


def index_two_updates(spark, sf):
    """The documents after both updates: what came has new ids in order of path, what failed or stayed the same its old record."""
    index, walked, read = _two_states(spark, sf, True)
    diff = index.diff(walked, "/corpus")
    index.apply(walked, diff, read.join(diff.where("status in ('new', 'changed')").select("path"), "path", "left_semi"))
    return index.docs().select("doc_id", "path", F.md5("text").alias("text_md5"), F.unix_seconds("mtime").alias("mtime"), F.col("segment").cast("long").alias("segment"))


def parsed_files(spark, sf):
    """Files of every kind with a text form, made from the documents, through the readers."""
    docs, i = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null"), F.col("doc_id").cast("string")
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    text = lambda *x: F.encode(F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x]), "UTF-8")
    contents = {
        ".txt": F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")),
        ".TEXT": F.concat(text("caf"), F.unhex(F.lit("E9")), text(" ", i)),
        ".md": text("---\nid: ", i, "\n---\n# Title ", i, " \n\nSee [", source, "](u", i, ") for **", lang, "** and `x` [open\n"),
        ".py": text("#!/bin/sh\nx = ", i, "  # note\ns = '# in'\n"),
        ".rs": text("let a = ", i, "; // gone\n/* b\n */let s = \"// in\";\n"),
        ".pdf": text("%PDF-1.4\n1 0 obj <</Title (Doc ", i, ")>> endobj\n2 0 obj <<>>\nstream\nBT (Hello \\(", i, "\\)) Tj T* [(wor) -20 (ld)] TJ ET\nendstream endobj"),
        ".go": F.concat(text("bad "), F.unhex(F.lit("FF"))),
        ".png": text("x"),
    }
    made = docs.select(F.explode(F.array(*[F.struct(F.concat(F.lit("/f/d"), i, F.lit(e)).alias("path"), c.alias("content")) for e, c in contents.items()])).alias("f")).select("f.*")
    read = files.parse_contents(made)
    return read.select("path", kind(F.col("path")).alias("kind"), F.coalesce(language(F.col("path")), F.lit("-")).alias("language"), F.coalesce(F.md5("text"), F.lit("-")).alias("text_md5"), F.coalesce("title", F.lit("-")).alias("title"), F.coalesce(F.regexp_extract("error", "^[A-Za-z]+", 0), F.lit("-")).alias("error"))


def rendered_recent(spark, sf):
    """The lines of a listing in two output formats."""
    found = _docs(spark, sf).recent("60d", 20)
    lines = [(form, k, line) for form in ("plain", "tsv") for k, line in enumerate(render(found.withColumn("snippet", F.lit("a\tb\nc")), form).split("\n"))]
    return spark.createDataFrame(lines or [("", 0, "")], "form string, n long, line string").where("form != ''")


def stems_and_spans(spark, sf):
    """File names and stems of the documents; the proximity score of a number of their trigrams' spans."""
    docs = corpus.documents(spark, sf).select("doc_id", "path")
    spans = post.min_span_of_postings(post.build(corpus.documents(spark, sf)), list(SPAN))
    rows = docs.join(spans, "doc_id", "left")
    return rows.select("doc_id", file_name(F.col("path")).alias("name"), file_stem(F.col("path")).alias("stem"), F.round(proximity_score(F.col("span")), 9).alias("proximity"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        normalize_text, word_tokens, snippets, doc_trigram_count, trigram_postings, trigram_df_topk, trigram_candidates_one_word, trigram_candidates_multi_word, search_score_topk, search_index_topk, search_title_boost,
        contextual_snippets, min_span_pair, meta_doc_type, meta_dates, meta_amounts, meta_emails, meta_entities, recent_topk, lsh_bands, lsh_cluster_sets, lsh_cluster_members, hamming_near, simhash_fingerprint, similar_topk, clusters_docs,
        index_diff_status, index_update_stats, index_two_updates, parsed_files, rendered_recent, stems_and_spans,
    )
} | {
    "query_type": _query("type:contract"),
    "query_path": _query("path:src3", _docs),
    "query_amount_range": _query("amount:>300K amount:<=310,000"),
    "query_date_year": _query("date:>=1995 date:<1996-01-01"),
    "query_email": _query("email:desk42@"),
    "query_since": _query("since:2w"),
    "query_not": _query("NOT type:invoice NOT type:contract"),
    "query_or": _query("type:invoice OR amount:<2000"),
    "query_mixed_text": _query('agreement "sum is" AND (type:contract OR NOT amount:>100K)'),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


_DOCS = f"""docs AS (
  SELECT doc_id, '/corpus/' || source || '/doc_' || doc_id || '.txt' AS path, 1704067200 - doc_id % 730 * 86400 AS mtime, text,
         trim(regexp_replace(lower(text), '{WS}', ' ', 'g'), ' ') AS norm
  FROM documents WHERE text IS NOT NULL)"""


def _grams(source: str) -> str:
    """CTEs of the byte trigrams and postings of a source with doc_id and norm."""
    return f"""byte AS (
  SELECT doc_id, unnest(regexp_extract_all(hex(encode(norm)), '..')) AS b, generate_subscripts(regexp_extract_all(hex(encode(norm)), '..'), 1) - 1 AS i FROM {source}),
gram AS (
  SELECT doc_id, i, b || lead(b, 1) OVER w || lead(b, 2) OVER w AS t FROM byte WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
post AS (SELECT t AS trigram, doc_id, count(*) AS tf, min(i) AS first, max(i) AS last FROM gram WHERE t IS NOT NULL GROUP BY t, doc_id)"""


_GRAMS = f"{_DOCS}, {_grams('docs')}"
_LETTERS = """letter AS (
  SELECT o_orderkey AS doc_id, '/orders/' || o_orderpriority[1] || '/letter_' || o_orderkey || '.txt' AS path, 'Letter ' || o_orderkey AS title, 1704067200 - o_orderkey % 730 * 86400 AS mtime,
    CASE o_orderkey % 3 WHEN 0 THEN 'Invoice number ' WHEN 1 THEN 'This agreement has the number ' ELSE 'Note ' END || o_orderkey || ' dated ' ||
    CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%d %B %Y') ELSE strftime(o_orderdate, '%B %d, %Y') END || '. The sum is $' || format('{:,.2f}', round(o_totalprice, 2)) ||
    ' for Mister Customer Number, limit $' || (o_orderkey % 50 + 1) || 'K. Write to Desk' || (o_custkey % 100) || '@Example.com or office@example.org.' AS text
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _numbered_months(column: str) -> str:
    for names in (meta.MONTH_NAMES, meta.MONTHS):
        for i, m in enumerate(names, 1):
            column = f"replace({column}, '{m}', '{i:02d}')"
    return f"replace({column}, ',', '')"


_UNITS = " ".join(f"WHEN '{u}' THEN {n}" for u, n in (("million", "1e6"), ("m", "1e6"), ("billion", "1e9"), ("b", "1e9"), ("thousand", "1e3"), ("k", "1e3")))
_META = f"""{_LETTERS}, meta AS (
  SELECT *, CASE WHEN contains(lower(text), 'this agreement') THEN 'contract' WHEN contains(lower(text), 'invoice number') THEN 'invoice' END AS doc_type,
    list_distinct(list_transform(regexp_extract_all(text, '{meta.EMAIL}'), lambda x: lower(x))) AS emails,
    list_distinct(regexp_extract_all(text, '{meta.ENTITY}')) AS entities,
    list_distinct(list_transform(list_zip(regexp_extract_all(text, '{meta.AMOUNT}', 1), regexp_extract_all(text, '{meta.AMOUNT}', 2)),
      lambda x: replace(x[1], ',', '')::DOUBLE * CASE lower(coalesce(x[2], '')) {_UNITS} ELSE 1e0 END)) AS amounts,
    list_distinct(list_filter(list_transform(regexp_extract_all(text, '{meta.DATE}'),
      lambda x: coalesce(try_strptime(x, '%Y-%m-%d'), try_strptime(x, '%m/%d/%Y'), try_strptime({_numbered_months("x")}, '%d %m %Y'), try_strptime({_numbered_months("x")}, '%m %d %Y'))::DATE), lambda d: d IS NOT NULL)) AS dates
  FROM letter)"""


def _trigrams_sql(text: str) -> list[str]:
    return [t.hex().upper() for w in word_trigrams(text) for t in w]


def _candidates_sql(text: str) -> str:
    parts = []
    for word in word_trigrams(text):
        own = ", ".join(f"'{t.hex().upper()}'" for t in word)
        parts.append(f"SELECT doc_id FROM post WHERE trigram IN ({own}) GROUP BY doc_id HAVING count(*) = {len(word)}")
    return " UNION ".join(parts)


def _recency(column: str = "mtime") -> str:
    return f"exp(-(1704067200 - {column}) / 15552000e0)"


def _search_sql(text: str, ctes: str = _GRAMS, source: str = "docs", predicate: str = "true", more: str = "0e0", limit: int = 20) -> str:
    wanted = list(dict.fromkeys(_trigrams_sql(text)))
    return f"""WITH {ctes}, cand AS ({_candidates_sql(text)}),
    feature AS (SELECT doc_id, count(*) AS m, sum(tf) AS p FROM post WHERE trigram IN ({", ".join(f"'{t}'" for t in wanted)}) GROUP BY doc_id),
    scored AS (SELECT path, 0.45e0 * (m / {len(wanted)}e0 * 0.7e0 + (1e0 + ln(p)) / (2e0 + ln(p)) * 0.3e0) + 0.10e0 * {_recency()} + {more} AS s
      FROM cand JOIN feature USING (doc_id) JOIN {source} USING (doc_id) WHERE {predicate})
    SELECT path, round(s, 6) AS score FROM scored ORDER BY s DESC, path LIMIT {limit}"""


def _query_sql(predicate: str, structural: str, source: str = "meta", limit: int = 25) -> str:
    ctes = _META if source == "meta" else _DOCS
    return f"""WITH {ctes}, scored AS (SELECT path, 0.10e0 * {_recency()} + 0.20e0 * ({structural}) AS s FROM {source} WHERE {predicate})
    SELECT path, round(s, 6) AS score FROM scored ORDER BY s DESC, path LIMIT {limit}"""


# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_U = "18446744073709551616::UHUGEINT"


def _turn(x: str, bits: int) -> str:
    """x, under 2**64, rotated left: a product modulo 2**64 - 1 (wrong for that number itself only)."""
    return f"(({x}) * {1 << bits}::UHUGEINT % ({_U} - 1))"


def _round(x: str, word: str) -> str:
    return f"({_turn(f'({x} + {word} * {_P2}::UHUGEINT) % {_U}', 31)} * {_P1}::UHUGEINT % {_U})"


def _merge(x: str, lane: str) -> str:
    return f"((xor({x}, {_round('0::UHUGEINT', lane)}) * {_P1}::UHUGEINT + {_P4}) % {_U})"


def _lane(j: int, start: int) -> str:
    own = f"list_transform(range(0, L // 32), lambda i: w[4 * i + {j + 1}])"
    return f"list_reduce(list_prepend({start % (1 << 64)}::UHUGEINT, {own}), lambda x, k: {_round('x', 'k')})"


def _fold(start: str, items: str, step: str) -> str:
    return f"list_reduce(list_prepend({start}, {items}), lambda x, k: {step})"


def _xxh64_ctes(source: str) -> str:
    """CTE ``xxh`` with (s, h): XXH64 of the distinct strings s of a source; every step of the hash spelled out."""
    little = lambda at, n: "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::UBIGINT::UHUGEINT"
    turned = " + ".join(_turn(f"v{j + 1}", r) for j, r in enumerate((1, 7, 12, 18)))
    merged = f"({turned}) % {_U}"
    for j in range(4):
        merged = _merge(merged, f"v{j + 1}")
    eight = f"({_turn(f'xor(x, {_round("0::UHUGEINT", "k")})', 27)} * {_P1}::UHUGEINT + {_P4}) % {_U}"
    four = f"({_turn(f'xor(h, ({little("L // 8 * 8", 4)}) * {_P1}::UHUGEINT % {_U})', 23)} * {_P2}::UHUGEINT + {_P3}) % {_U}"
    one = f"{_turn(f'xor(x, k * {_P5}::UHUGEINT % {_U})', 11)} * {_P1}::UHUGEINT % {_U}"
    tail = f"list_transform(range(L - L % 4, L), lambda i: {little('i', 1)})"
    return f"""x0 AS (SELECT DISTINCT s FROM {source}),
x1 AS (SELECT s, hex(encode(s)) AS x, strlen(s) AS L FROM x0),
x2 AS (SELECT s, x, L, list_transform(range(0, L // 8), lambda i: {little('8 * i', 8)}) AS w FROM x1),
x3 AS (SELECT *, {_lane(0, _P1 + _P2)} AS v1, {_lane(1, _P2)} AS v2, {_lane(2, 0)} AS v3, {_lane(3, -_P1)} AS v4 FROM x2),
x4 AS (SELECT s, x, L, w, (CASE WHEN L >= 32 THEN {merged} ELSE {_P5}::UHUGEINT END + L::UHUGEINT) % {_U} AS h FROM x3),
x5 AS (SELECT s, x, L, {_fold('h', 'w[L // 32 * 4 + 1:]', eight)} AS h FROM x4),
x6 AS (SELECT s, x, L, CASE WHEN L % 8 >= 4 THEN {four} ELSE h END AS h FROM x5),
x7 AS (SELECT s, {_fold('h', tail, one)}::UBIGINT AS h FROM x6),
x8 AS (SELECT s, (xor(h, h >> 33)::UHUGEINT * {_P2}::UHUGEINT % {_U})::UBIGINT AS h FROM x7),
x9 AS (SELECT s, (xor(h, h >> 29)::UHUGEINT * {_P3}::UHUGEINT % {_U})::UBIGINT AS h FROM x8),
xxh AS (SELECT s, xor(h, h >> 32) AS h FROM x9)"""


_BITS = ", ".join(f"sum((h >> {i}) & 1) AS b{i}" for i in range(64))
_VALUE = " + ".join(f"(2 * b{i} > n)::UHUGEINT * {1 << i}::UHUGEINT" for i in range(64))
_NUMBERS = f"""{_DOCS}, word AS (SELECT doc_id, list_filter(string_split(norm, ' '), lambda x: x <> '') AS w FROM docs),
shingle AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM word),
{_xxh64_ctes('shingle')},
vote AS (SELECT doc_id, count(*) AS n, {_BITS} FROM shingle JOIN xxh USING (s) GROUP BY doc_id),
simhash AS (SELECT doc_id, path, CASE WHEN v IS NULL THEN 0 WHEN v >= 9223372036854775808 THEN (v::HUGEINT - 18446744073709551616)::BIGINT ELSE v::BIGINT END AS h
  FROM docs LEFT JOIN (SELECT doc_id, {_VALUE} AS v FROM vote) USING (doc_id)),
fp AS (SELECT * FROM simhash WHERE h != 0)"""


def _bands_sql(n: int) -> str:
    width = 64 // n
    mask = (1 << width) - 1
    # an arithmetic shift brings in ones only above a band's bits
    return " UNION ALL ".join(f"SELECT doc_id, path, h, {i} AS band, (h >> {i * width}) & {mask} AS value FROM fp" for i in range(n))


_SETS = f"sets AS (SELECT DISTINCT list(doc_id ORDER BY doc_id) AS m FROM ({_bands_sql(4)}) GROUP BY band, value HAVING count(*) > 1)"
_STATES = """first AS (
  SELECT row_number() OVER (ORDER BY '/corpus/' || source || '/doc_' || doc_id || '.txt') - 1 AS id, '/corpus/' || source || '/doc_' || doc_id || '.txt' AS path, text, coalesce(lang, '-') AS lang, n_chars > 2000 AS long, 1704067200 - doc_id % 730 * 86400 AS mtime,
    '/doc_' || doc_id || '.txt' AS file, source FROM documents WHERE text IS NOT NULL),
walk AS (SELECT *, CASE WHEN lang = 'de' THEN 'new' WHEN (long OR lang = 'es') AND mtime != 1704067200 THEN 'changed' ELSE 'same' END AS status,
  CASE WHEN lang = 'de' THEN '/corpus/moved/' ELSE '/corpus/' END || source || file AS new_path, CASE WHEN long OR lang = 'es' THEN 1704067200 ELSE mtime END AS new_mtime FROM first)"""
_LETTER_GRAMS = f"{_META}, normal AS (SELECT *, trim(regexp_replace(lower(text), '{WS}', ' ', 'g'), ' ') AS norm FROM meta), {_grams('normal')}"
_CONTRACT, _LARGE = "coalesce(doc_type = 'contract', false)", "len(list_filter(amounts, lambda a: a > 100000)) > 0"

ORACLE_SQL: dict[str, str] = {
    "search_title_boost": _search_sql(TITLED, _LETTER_GRAMS, "normal", more="0.05e0 * (contains(lower(title), 'letter') OR contains(lower(title), '4217'))::INT"),
    "query_mixed_text": _search_sql("agreement sum is", _LETTER_GRAMS, "normal", f"({_CONTRACT} OR NOT {_LARGE})", f"0.20e0 * (({_CONTRACT})::INT + (NOT {_LARGE})::INT) / 2e0", 25),
    "normalize_text": f"WITH {_DOCS} SELECT doc_id, md5(norm) AS norm_md5, length(norm) AS n FROM docs",
    "word_tokens": f"WITH {_DOCS}, w AS (SELECT doc_id, list_filter(string_split(norm, ' '), lambda x: x <> '') AS l FROM docs) SELECT doc_id, len(l)::BIGINT AS n_words, len(list_distinct(l))::BIGINT AS n_distinct FROM w",
    "snippets": "SELECT doc_id, md5(left(text, 256)) AS snippet_md5 FROM documents WHERE text IS NOT NULL",
    "doc_trigram_count": f"WITH {_GRAMS} SELECT d.doc_id, count(p.trigram) AS n_trigrams, coalesce(sum(tf), 0)::BIGINT AS n_positions FROM docs d LEFT JOIN post p USING (doc_id) GROUP BY d.doc_id",
    "trigram_postings": f"WITH {_GRAMS} SELECT trigram, doc_id, tf, first, last FROM post",
    "trigram_df_topk": f"WITH {_GRAMS} SELECT trigram, count(*) AS df, sum(tf)::BIGINT AS tf FROM post GROUP BY trigram ORDER BY df DESC, 3 DESC, trigram LIMIT 50",
    "trigram_candidates_one_word": f"WITH {_GRAMS} {_candidates_sql(WORD)}",
    "trigram_candidates_multi_word": f"WITH {_GRAMS} {_candidates_sql(SEARCH)}",
    "search_score_topk": _search_sql(SEARCH),
    "search_index_topk": _search_sql(SEARCH),
    "contextual_snippets": f"""WITH a AS (SELECT doc_id, text, CASE WHEN instr(lower(text), '{WORD}') > 0 THEN instr(lower(text), '{WORD}') WHEN instr(lower(text), 'ation') > 0 THEN instr(lower(text), 'ation') END AS p FROM documents WHERE text IS NOT NULL),
      b AS (SELECT *, greatest(p - 41, 0) AS s, least(p + 39, length(text)) AS e FROM a)
      SELECT doc_id, md5(CASE WHEN p IS NULL THEN 'none' ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || replace(regexp_replace(substring(text, s + 1, e - s), '^{WS}|{WS}$', '', 'g'), chr(10), ' ')
      || CASE WHEN e < length(text) THEN '...' ELSE '' END END) AS snippet_md5 FROM b""",
    "min_span_pair": f"""WITH {_GRAMS}, pos AS (SELECT doc_id, i, t FROM gram WHERE t IN ('{SPAN[0].hex().upper()}', '{SPAN[1].hex().upper()}')),
      back AS (SELECT doc_id, i, max(CASE WHEN t = '{SPAN[0].hex().upper()}' THEN i END) OVER w AS a, max(CASE WHEN t = '{SPAN[1].hex().upper()}' THEN i END) OVER w AS b FROM pos WINDOW w AS (PARTITION BY doc_id ORDER BY i))
      SELECT doc_id, min(i - least(a, b)) AS span FROM back WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY doc_id""",
    "stems_and_spans": f"""WITH {_GRAMS}, pos AS (SELECT doc_id, i, t FROM gram WHERE t IN ('{SPAN[0].hex().upper()}', '{SPAN[1].hex().upper()}')),
      back AS (SELECT doc_id, i, max(CASE WHEN t = '{SPAN[0].hex().upper()}' THEN i END) OVER w AS a, max(CASE WHEN t = '{SPAN[1].hex().upper()}' THEN i END) OVER w AS b FROM pos WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
      s AS (SELECT doc_id, min(i - least(a, b)) AS span FROM back WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY doc_id)
      SELECT doc_id, 'doc_' || doc_id || '.txt' AS name, 'doc_' || doc_id AS stem, round(CASE WHEN span IS NULL THEN 0e0 WHEN span = 0 THEN 1e0 ELSE 1 / (1 + greatest(ln(span::DOUBLE), 0e0)) END, 9) AS proximity FROM docs LEFT JOIN s USING (doc_id)""",
    "meta_doc_type": f"WITH {_META} SELECT coalesce(doc_type, '-') AS doc_type, count(*) AS n FROM meta GROUP BY 1",
    "meta_dates": f"WITH {_META} SELECT doc_id, strftime(unnest(dates), '%Y-%m-%d') AS d FROM meta",
    "meta_amounts": f"WITH {_META} SELECT doc_id, unnest(amounts) AS amount FROM meta",
    "meta_emails": f"WITH {_META} SELECT doc_id, unnest(emails) AS email FROM meta",
    "meta_entities": f"WITH {_META} SELECT doc_id, unnest(entities) AS entity FROM meta",
    "query_type": _query_sql("doc_type = 'contract'", "1e0"),
    "query_path": _query_sql("contains(lower(path), 'src3')", "1e0", "docs"),
    "query_amount_range": _query_sql("len(list_filter(amounts, lambda a: a > 300000)) > 0 AND len(list_filter(amounts, lambda a: a <= 310000)) > 0", "1e0"),
    "query_date_year": _query_sql("len(list_filter(dates, lambda d: d >= DATE '1995-01-01')) > 0 AND len(list_filter(dates, lambda d: d < DATE '1996-01-01')) > 0", "1e0"),
    "query_email": _query_sql("len(list_filter(emails, lambda e: contains(e, 'desk42@'))) > 0", "1e0"),
    "query_since": _query_sql("mtime >= 1704067200 - 14 * 86400", "1e0"),
    "query_not": _query_sql("doc_type IS NULL", "1e0"),
    "query_or": _query_sql("coalesce(doc_type = 'invoice', false) OR len(list_filter(amounts, lambda a: a < 2000)) > 0", "(coalesce(doc_type = 'invoice', false)::INT + (len(list_filter(amounts, lambda a: a < 2000)) > 0)::INT) / 2e0"),
    "recent_topk": f"WITH {_DOCS}, page AS (SELECT path, mtime FROM docs WHERE mtime >= 1704067200 - 60 * 86400 ORDER BY mtime DESC, path LIMIT 20) SELECT path, round(mtime / max(mtime) OVER ()::DOUBLE, 6) AS score FROM page",
    "lsh_bands": f"WITH {_NUMBERS} SELECT doc_id, band::BIGINT AS band, value FROM ({_bands_sql(8)})",
    "lsh_cluster_sets": f"""WITH {_NUMBERS}, {_SETS} SELECT len(m)::BIGINT AS size, m[1] AS first, m[-1] AS last FROM sets""",
    "lsh_cluster_members": f"""WITH {_NUMBERS}, {_SETS} SELECT doc_id, size, count(*) AS n FROM (SELECT unnest(m) AS doc_id, len(m)::BIGINT AS size FROM sets) GROUP BY doc_id, size""",
    "hamming_near": f"""WITH {_NUMBERS}, v AS (SELECT h, min(doc_id) AS id, count(*) AS n FROM fp GROUP BY h) SELECT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h))::BIGINT AS distance, x.n AS n_a, y.n AS n_b
      FROM v x JOIN v y ON x.id < y.id WHERE bit_count(xor(x.h, y.h)) <= 3""",
    "simhash_fingerprint": f"WITH {_NUMBERS} SELECT doc_id, h AS simhash FROM simhash",
    "similar_topk": f"""WITH {_NUMBERS}, d AS (SELECT path, bit_count(xor(h, (SELECT h FROM simhash WHERE path = '/corpus/src0/doc_0.txt'))) AS d FROM fp WHERE path != '/corpus/src0/doc_0.txt')
      SELECT path, round(1 - d / 64e0, 6) AS score FROM d ORDER BY d, path LIMIT 20""",
    "clusters_docs": f"""WITH {_NUMBERS}, c AS (SELECT DISTINCT list(path ORDER BY path) AS m FROM ({_bands_sql(4)}) GROUP BY band, value HAVING count(*) > 1)
      SELECT len(m)::INT AS size, array_to_string(m[1:5], ',') AS members, greatest(len(m) - 5, 0)::INT AS more FROM c ORDER BY len(m) DESC, m[1], m[-1] LIMIT 20""",
    "index_diff_status": f"WITH {_STATES} SELECT status, count(*) AS n FROM walk GROUP BY status UNION ALL SELECT 'removed', count(*) FROM first WHERE lang = 'de' HAVING count(*) > 0",
    "index_update_stats": f"""WITH {_STATES} SELECT count(*) FILTER (status != 'same' AND lang != 'fr' AND (lang = 'de' OR long)) AS added,
      count(*) FILTER (status = 'same' OR status = 'changed' AND lang != 'fr' AND NOT long) AS skipped, count(*) FILTER (lang = 'de') AS removed, count(*) FILTER (lang = 'fr' AND status != 'same') AS errors FROM walk""",
    "index_two_updates": f"""WITH {_STATES}, came AS (SELECT *, row_number() OVER (ORDER BY new_path) + (SELECT count(*) FROM first) - 1 AS new_id FROM walk WHERE status != 'same' AND lang != 'fr' AND (lang = 'de' OR long))
      SELECT new_id AS doc_id, new_path AS path, md5(CASE WHEN long THEN text || chr(10) || 'more' ELSE text END) AS text_md5, new_mtime AS mtime, 1::BIGINT AS segment FROM came
      UNION ALL SELECT id, path, md5(text), mtime, 0 FROM first WHERE lang != 'de' AND path NOT IN (SELECT new_path FROM came)""",
    "parsed_files": """WITH d AS (SELECT '/f/d' || doc_id AS p, doc_id::VARCHAR AS i, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang, chr(10) AS nl FROM documents WHERE text IS NOT NULL)
      SELECT p || '.txt' AS path, 'text' AS kind, '-' AS language, md5(text) AS text_md5, '-' AS title, '-' AS error FROM d
      UNION ALL SELECT p || '.TEXT', 'text', '-', md5('café ' || i), '-', '-' FROM d
      UNION ALL SELECT p || '.md', 'markdown', '-', md5(nl || 'Title ' || i || nl || nl || 'See ' || source || ' for ' || lang || ' and x [open' || nl), 'Title ' || i, '-' FROM d
      UNION ALL SELECT p || '.py', 'code', 'python', md5('#!/bin/sh' || nl || 'x = ' || i || nl || 's = ' || chr(39) || '# in' || chr(39)), 'd' || i || '.py', '-' FROM d
      UNION ALL SELECT p || '.rs', 'code', 'rust', md5('let a = ' || i || '; ' || nl || 'let s = "// in";' || nl), 'd' || i || '.rs', '-' FROM d
      UNION ALL SELECT p || '.pdf', 'pdf', '-', md5('Hello (' || i || ') world'), 'Doc ' || i, '-' FROM d
      UNION ALL SELECT p || '.go', 'code', 'go', '-', '-', 'ParseError' FROM d
      UNION ALL SELECT p || '.png', 'unknown', '-', '-', '-', 'UnsupportedFileType' FROM d""",
    "rendered_recent": f"""WITH {_DOCS}, page AS (SELECT path, mtime FROM docs WHERE mtime >= 1704067200 - 60 * 86400 ORDER BY mtime DESC, path LIMIT 20),
      hit AS (SELECT path, mtime / max(mtime) OVER ()::DOUBLE AS score FROM page), ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS k FROM hit)
      SELECT 'tsv' AS form, k - 1 AS n, path || chr(9) || format('{{:.6f}}', score) || chr(9) || 'a b c' AS line FROM ranked
      UNION ALL SELECT 'plain', 2 * k - 2, '[' || k || '] ' || path || ' (score: ' || format('{{:.3f}}', score) || ', type: doc)' FROM ranked
      UNION ALL SELECT 'plain', 2 * k - 1, '    a' || chr(9) || 'b' FROM ranked""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
