"""Every operator as a query over its whole table, and as SQL where SQL has words for it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragassay.llm import (
    dropout,
    maxent,
    minhash,
    nbsvm,
    packing,
    periodic,
    radix,
    resample,
    revisit,
    simhash,
    suffix,
    urltree,
    winnow,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return nbsvm.scores(docs, nbsvm.train(docs, table(spark, sf_dir, "labels")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffix.repeated_passages(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "start_word", "end_word", "source_doc_ids")


def op3_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisit.resolve(revisit.archive(table(spark, sf_dir, "pages")))
    entries = F.transform(
        F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    )
    return found.withColumns(
        {"headers": F.array_join(entries, "; "), "response_id": F.col("response_id").cast("string")}
    )


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return dropout.round_trip(table(spark, sf_dir, "documents"), model, seed=17, rate=0.1)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_pairs_with_neighbours(table(spark, sf_dir, "documents"))


def op6_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = winnow.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return cut.select(
        "doc_id", F.char_length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("text_sha256")
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.exact_groups(table(spark, sf_dir, "documents"))


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer, capacity=4096, end=1)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), shingle=4)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(
        table(spark, sf_dir, "documents"),
        table(spark, sf_dir, "benchmark"),
        lo=1, hi=1, buckets=10_000, seed=2024, percent=10, least_words=20,
    )
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    corpus, model = maxent.train(docs.filter(~held_out))
    return maxent.scores(docs, corpus, model, held_out)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents"), least=24, times=3, edit=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_nbsvm_quality,
        op2_suffix_dedup,
        op3_revisit_resolution,
        op4_merge_dropout,
        op5_simhash,
        op6_line_winnowing,
        op7_exact_dedup,
        op8_url_templates,
        op9_best_fit_packing,
        op10_minhash_dedup,
        op11_importance_resampling,
        op12_maxent_scores,
        op13_periodic_runs,
    )
}

_LOWER = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

_BLANK = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"


def _rules(value: Callable[[str, str, str], str]) -> str:
    cases = []
    for host, path, says in sorted(urltree.RULES, key=lambda r: -len(r[0] + r[1])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        cases.append(f"WHEN {fits} THEN '{value(host, path, says)}'")
    return "CASE " + " ".join(cases)


SQL = {
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM d""",
    "op10_minhash_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS words
            FROM documents),
        s AS (
            SELECT doc_id, CASE
                WHEN len(words) = 0 THEN []
                WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(
                    [array_to_string(words[i:i + 3], ' ') for i in range(1, len(words) - 2)])
                END AS grams
            FROM w),
        g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
        common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS inter
            FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id
            GROUP BY ALL),
        links AS (
            SELECT x, y FROM common WHERE 100 * inter >= 80 * (nx + ny - inter)),
        edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
        reach AS (
            SELECT doc_id, doc_id AS other FROM s
            UNION
            SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x)
        SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, c.component_id,
               s.doc_id = c.component_id AS kept
        FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c
          ON s.doc_id = c.doc_id""",
    "op3_revisit_resolution": r"""
        WITH p AS (
            SELECT page_id AS n, page_id * 7919 % 2592000 AS start, length(coalesce(html, '')) AS size,
                   substr(md5(coalesce(html, '')), 1, 12) AS digest,
                   regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
            FROM pages),
        parts AS (
            SELECT *, concat('day ', start // 86400) AS day,
                   regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www[.]', ''),
                                  ':(80|443)$', '') AS host,
                   regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') AS path,
                   regexp_replace(regexp_replace(regexp_extract(rest, '[?](.*)$', 1),
                       '(^|&)(utm_[a-z]+|gclid|fbclid)=[^&]*', '', 'g'), '^&', '') AS query
            FROM p),
        c AS (
            SELECT *, concat(host, path, CASE WHEN query <> '' THEN '?' || query ELSE '' END) AS url
            FROM parts),
        full_ones AS (
            SELECT n * 3 AS id, url, start AS ts, CASE WHEN n % 5 > 0 THEN digest END AS etag, day, size FROM c),
        revisits AS (
            SELECT n * 3 + 1 AS id, url, start + 3600 * (1 + n % 5) AS ts,
                   CASE WHEN n % 4 = 0 THEN digest WHEN n % 7 = 0 THEN 'other' ELSE digest END AS etag,
                   CASE WHEN n % 3 > 0 THEN day END AS day, start + 3600 AS date, 'max-age=10' AS control, '' AS more
            FROM c
            UNION ALL
            SELECT n * 3 + 2, url, start - 40000 + 86400 * (n % 9), NULL,
                   CASE WHEN n % 2 = 0 THEN day WHEN n % 3 = 0 THEN 'day x' END, start + 86400, 'max-age=60',
                   '; expires: 0'
            FROM c),
        met AS (
            SELECT r.*, f.id AS of, f.etag AS f_etag, f.day AS f_day, f.size
            FROM revisits r LEFT JOIN full_ones f ON f.url = r.url AND f.ts < r.ts
            QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY f.ts DESC NULLS LAST, f.id DESC) = 1),
        said AS (
            SELECT *, CASE
                WHEN of IS NULL THEN 'no response'
                WHEN etag IS NOT NULL AND f_etag IS NOT NULL
                    THEN CASE WHEN etag = f_etag THEN 'resolved' ELSE 'changed' END
                WHEN day IS NOT NULL AND f_day IS NOT NULL
                    THEN CASE WHEN day = f_day THEN 'resolved' ELSE 'changed' END
                ELSE 'no validator' END AS state
            FROM met)
        SELECT id AS record_id, url, ts, CASE WHEN state = 'resolved' THEN CAST(of AS VARCHAR) END AS response_id, state,
               CASE WHEN state = 'resolved' THEN concat('cache-control: ', control, '; content-length: ', size,
                    '; content-type: text/html; date: ', date, more) END AS headers
        FROM said""",
    "op6_line_winnowing": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS place FROM d),
        ink AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS no
            FROM l WHERE trim(line, {_BLANK}) <> ''),
        runs AS (
            SELECT doc_id, no, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c
            FROM ink WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
        later AS (
            SELECT doc_id, no FROM runs WHERE c IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, no) > 1),
        alone AS (
            SELECT doc_id, no FROM ink WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {winnow.WORDS}
            QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, no) > 1),
        gone AS (SELECT DISTINCT doc_id, no + k AS no FROM later, range(3) r(k) UNION SELECT doc_id, no FROM alone),
        dropped AS (SELECT doc_id, place FROM ink JOIN gone USING (doc_id, no)),
        kept AS (
            SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.place)
                       FILTER (WHERE x.place IS NULL), '') AS text
            FROM l LEFT JOIN dropped x ON x.doc_id = l.doc_id AND x.place = l.place GROUP BY l.doc_id)
        SELECT doc_id, length(text) AS n_chars, sha256(text) AS text_sha256 FROM kept""",
    "op8_url_templates": f"""
        WITH RECURSIVE p AS (
            SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0
                THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
        h AS (
            SELECT page_id, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                   translate(regexp_extract(rest, '^[^/?#]*', 0),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM p),
        s AS (
            SELECT *, regexp_extract(path, '[0-9]+', 0) AS digits,
                   [x for x in string_split(path, '/') if x <> ''] AS parts FROM h),
        marks AS (
            SELECT doc_id AS number, 1 - min(quality) AS bad FROM labels WHERE quality IN (0, 1)
            GROUP BY doc_id HAVING min(quality) = max(quality)),
        marked AS (
            SELECT page_id, host, path, parts, bad
            FROM s LEFT JOIN marks ON length(digits) BETWEEN 1 AND 18
                 AND number = TRY_CAST(digits AS BIGINT)),
        tree AS (
            SELECT host, parts, 0 AS d, '' AS parent, '' AS template FROM (SELECT DISTINCT host, parts FROM marked)
            UNION ALL
            SELECT host, parts, d + 1, template,
                   concat(template, '/', CASE WHEN rare AND n_rare >= {urltree.FAN_OUT} THEN '*' ELSE child END)
            FROM (SELECT *, count(DISTINCT CASE WHEN rare THEN child END) OVER (PARTITION BY host, template) AS n_rare
                  FROM (SELECT *, NOT merged AND count(*) OVER (PARTITION BY host, template, child, merged)
                                                 <= {urltree.RARE} AS rare
                        FROM (SELECT *, CASE WHEN merged THEN mask ELSE own END AS child
                              FROM (SELECT *, mask <> own AND count(DISTINCT own) OVER (PARTITION BY host, template, mask)
                                                              >= {urltree.SAME_BUT_DIGITS} AS merged
                                    FROM (SELECT *, parts[d + 1] AS own,
                                                 regexp_replace(parts[d + 1], '[0-9]+', '*', 'g') AS mask
                                          FROM tree WHERE len(parts) > d)))))),
        l4 AS (
            SELECT page_id, m.host, path, bad, parent, template
            FROM marked m JOIN tree t ON t.host = m.host AND t.parts = m.parts AND t.d = len(m.parts)),
        own AS (
            SELECT host, parent, template, count(bad) AS tl, coalesce(sum(bad), 0)::DOUBLE AS tb
            FROM l4 GROUP BY ALL),
        over AS (
            SELECT host, parent, count(bad) AS pl, coalesce(sum(bad), 0)::DOUBLE AS pb FROM l4 GROUP BY ALL),
        shares AS (
            SELECT o.*, CASE WHEN pl > 0 THEN pb / pl ELSE 0::DOUBLE END AS share
            FROM own o JOIN over v ON v.host = o.host AND v.parent = o.parent),
        branches AS (
            SELECT *, CASE WHEN abs(tb - tl * share) * abs(tb - tl * share)
                                <= tl * share * (1::DOUBLE - share) * 4::DOUBLE
                           THEN concat(parent, '/~') ELSE template END AS branch FROM shares),
        hosts AS (
            SELECT host, (sum(tb) + {urltree.CORPUS_WEIGHT}::DOUBLE
                          * (SELECT CASE WHEN sum(tl) > 0 THEN sum(tb) / sum(tl) ELSE 0::DOUBLE END FROM own))
                         / (sum(tl) + {urltree.CORPUS_WEIGHT}::DOUBLE) AS prior FROM own GROUP BY host),
        grouped AS (SELECT host, branch, sum(tl) AS gl, sum(tb) AS gb FROM branches GROUP BY ALL),
        scored AS (
            SELECT g.host, branch, (gb + {urltree.HOST_WEIGHT}::DOUBLE * prior)
                                   / (gl + {urltree.HOST_WEIGHT}::DOUBLE) AS impurity
            FROM grouped g JOIN hosts USING (host))
        SELECT page_id, l.host, path,
               {_rules(lambda h, p, v: h + p)} END AS rule,
               {_rules(lambda h, p, v: v)} WHEN impurity > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
               l.template
        FROM (SELECT page_id, host, path, parent, template FROM l4) l
        JOIN (SELECT host AS b_host, parent AS b_parent, template AS b_template, branch FROM branches)
          ON b_host = l.host AND b_parent = l.parent AND b_template = l.template
        JOIN (SELECT host AS g_host, branch AS g_branch, impurity FROM scored)
          ON g_host = l.host AND g_branch = branch""",
    "op11_importance_resampling": f"""
        WITH table_of AS (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS tab
            FROM range(256) r(i)),
        texts AS (
            SELECT 0 AS kind, doc_id AS id, {_LOWER} AS t FROM documents
            UNION ALL SELECT 1, item_id, {_LOWER} FROM benchmark),
        words AS (
            SELECT kind, id, unnest(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
            FROM texts),
        spelled AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
        buckets AS (
            SELECT w, xor(list_reduce(
                       [4294967295] || [CAST('0x' || substr(h, 2 * k - 1, 2) AS BIGINT) for k in range(1, len(h) // 2 + 1)],
                       lambda a, x: xor(a // 256, tab[xor(a % 256, x) + 1])), 4294967295) % 10000 AS bucket
            FROM spelled, table_of),
        found AS (SELECT kind, id, bucket FROM words JOIN buckets USING (w)),
        sizes AS (
            SELECT bucket, count(*) FILTER (WHERE kind = 0) AS s, count(*) FILTER (WHERE kind = 1) AS t
            FROM found GROUP BY bucket),
        totals AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM sizes),
        gains AS (
            SELECT bucket, CAST(floor(1000::DOUBLE * ln((t + 1)::DOUBLE * (ss + 10000)::DOUBLE
                   / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE))) AS BIGINT) AS gain FROM sizes, totals),
        weighed AS (
            SELECT id, count(*) AS n, sum(gain)::BIGINT AS gain
            FROM found JOIN gains USING (bucket) WHERE kind = 0 GROUP BY id),
        scored AS (
            SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(gain, 0)::BIGINT AS weight,
                   coalesce(gain, 0)::BIGINT + CAST(floor(-1000::DOUBLE * ln(-ln((CAST('0x' ||
                       substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT)
                       AS score
            FROM documents LEFT JOIN weighed ON id = doc_id),
        placed AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able
            FROM scored WHERE n_features >= 20)
        SELECT s.doc_id, n_features, weight, score,
               CASE WHEN place <= 10 * able // 100 THEN place END AS rank
        FROM scored s LEFT JOIN placed p ON p.doc_id = s.doc_id""",
}
