"""One registered query for each operator over its whole table, and its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrain.llm import bpe, decontaminate, embeddings, filter_audit, fim, lm, quality, simhash, substring, suffix, toxicity, warc
from hourgrain.llm.common import table
from hourgrain.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), outputs=False)


@query("op2_embedding_near_dedup", """
    WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
    link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
    SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
    FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = v.vec_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY payload_digest)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest, CASE WHEN first != page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN first != page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_substring_dedup", r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
    k AS (SELECT doc_id, i, list_aggregate(words[i:i + 34], 'string_agg', ' ') AS win FROM p WHERE i + 34 <= len(words)),
    r AS (SELECT win FROM k GROUP BY win HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM k JOIN r USING (win)),
    kept AS (SELECT doc_id, string_agg(words[i], ' ' ORDER BY i) AS t, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(words)::BIGINT AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


@query("op9_suffix_dedup", """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
    k AS (SELECT doc_id, x, unnest(range(0, n - 99)) AS s FROM d),
    late AS (SELECT doc_id, s FROM k QUALIFY row_number() OVER (PARTITION BY md5(substr(x, 2 * s + 1, 200)) ORDER BY doc_id, s) > 1),
    marks AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS fresh FROM late),
    named AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM marks),
    spans AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM named GROUP BY doc_id, g),
    gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
      UNION ALL SELECT doc_id, coalesce(max(b), 0), NULL FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
    kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS t FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, n AS n_bytes, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(a) AS n_spans, any_value(sha256(unhex(t))) AS kept_sha256
    FROM d JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id) GROUP BY doc_id, n""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_earlier(table(spark, sf_dir, "documents"), texts=False)


@query("op5_benchmark_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents labelled good and not toxic, by every label they have."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return labels.where("quality = 1 AND toxic = 0").select("doc_id")


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


@query("op6_lm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op11_toxicity")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_fill_in_middle", r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256(concat('1:', doc_id)) AS x FROM documents),
    h AS (SELECT doc_id, t, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(x, i, 8))::BIGINT) AS h FROM d),
    c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM h),
    f AS (SELECT doc_id, n, t, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
        WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
      array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
    SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(m) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
      sha256(t) AS restored_sha256 FROM f""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(table(spark, sf_dir, "documents"), outputs=False)


@query("op13_filter_audit", r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, concat(CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
        CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
    c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
    o AS (SELECT concat(a.k, b.k, c.k, d.k, e.k) AS filter_order FROM x a, x b, x c, x d, x e
      WHERE a.k NOT IN (b.k, c.k, d.k, e.k) AND b.k NOT IN (c.k, d.k, e.k) AND c.k NOT IN (d.k, e.k) AND d.k != e.k),
    s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS k, left(filter_order, step - 1) AS before, left(filter_order, step) AS upto FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step)),
    r AS (SELECT part, filter_order, step, k, sum(n) FILTER (WHERE translate(fails, upto, '') = fails) AS kept,
        sum(n) FILTER (WHERE translate(fails, before, '') = fails AND contains(fails, k)) AS removed,
        sum(n) FILTER (WHERE translate(fails, before, '') != fails AND contains(fails, k)) AS redundant, sum(n) FILTER (WHERE fails = k) AS unique_fails,
        sum(good) FILTER (WHERE translate(fails, before, '') = fails AND contains(fails, k)) AS good_lost,
        sum(toxic) FILTER (WHERE translate(fails, before, '') = fails AND contains(fails, k)) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, k)
    SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
      coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
      (sum(coalesce(removed, 0)) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM r""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The same windows in SQL: words, placeholders, alignments, one-to-one slots.
_SLOTS = r"""
    SELECT id, i, bare AS w, CASE WHEN ascii(raw) BETWEEN 48 AND 57 OR bare IN ({numbers}) THEN '<num>' WHEN bare IN ({units}) THEN '<unit>'
      WHEN left(raw, 1) != lower(left(raw, 1)) AND i > 1 AND right(prev, 1) NOT IN ('.', '!', '?') THEN '<name>' END AS k
    FROM (SELECT id, i, words[i] AS raw, words[i - 1] AS prev, lower(rtrim(words[i], '.!?')) AS bare FROM (SELECT id, words, unnest(range(1, len(words) + 1)) AS i FROM
      (SELECT {id} AS id, regexp_extract_all(coalesce(text, ''), '(?:\p{{N}}+(?:[.,:/]\p{{N}}+)*|\p{{L}}[\p{{L}}\p{{N}}]*(?:[''’-][\p{{L}}\p{{N}}]+)*)[.!?]*') AS words FROM {table})))"""


def _slots(id_col: str, name: str) -> str:
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    return _SLOTS.format(id=id_col, table=name, numbers=quoted(decontaminate.NUMBER_WORDS), units=quoted(decontaminate.UNITS))


ORACLES["op5_benchmark_decontamination"] = f"""
    WITH d AS ({_slots("doc_id", "documents")}), b AS ({_slots("item_id", "benchmark")}),
    dw AS (SELECT id, i, list(coalesce(k, w)) OVER win AS t, list(CASE WHEN k IS NOT NULL THEN w END) OVER win AS v FROM d WINDOW win AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
    bw AS (SELECT id, i, list(coalesce(k, w)) OVER win AS t, list(CASE WHEN k IS NOT NULL THEN w END) OVER win AS v, count(*) FILTER (WHERE k IS NULL) OVER win >= 5 AS solid
      FROM b WINDOW win AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
    m AS (SELECT d.id AS doc_id, b.id AS item_id, d.i, b.i AS j, solid, b.v AS bv, d.v AS dv, solid AND b.v = d.v AS verbatim
      FROM (SELECT * FROM dw WHERE len(t) = 8) d JOIN (SELECT * FROM bw WHERE len(t) = 8) b ON d.t = b.t),
    p AS (SELECT DISTINCT doc_id, item_id, i - j AS shift, bv[n] AS x, dv[n] AS y FROM (SELECT *, unnest(range(1, 9)) AS n FROM m) WHERE bv[n] IS NOT NULL),
    c AS (SELECT doc_id, item_id, shift, count(*) = count(DISTINCT x) AND count(*) = count(DISTINCT y) AS one, bool_or(x != y) AS other FROM p GROUP BY ALL),
    e AS (SELECT m.*, coalesce(one, true) AS whole, coalesce(one, true) AND coalesce(other, false) AS re FROM m LEFT JOIN c ON c.doc_id = m.doc_id AND c.item_id = m.item_id AND shift = i - j),
    f AS (SELECT *, min(i) FILTER (WHERE solid) OVER (PARTITION BY doc_id, item_id, i - j) AS first FROM e)
    SELECT doc_id, item_id, count(DISTINCT j) AS n_windows, min(first) - 1 AS first_word, bool_or(re) AS reparameterised
    FROM f WHERE CASE WHEN whole THEN solid ELSE verbatim END GROUP BY doc_id, item_id"""
