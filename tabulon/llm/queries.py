"""The registered queries of this subpackage, with SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..workload.tables import table
from . import audit, exact, html_text, jaccard, language, licences, manifest, mixing, neighbours, ngram_model, pieces, secrets, substring
from .common import normalised

QUERIES, ORACLE = {}, {}


def query(key, sql=None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn
    return add


@query("op1_exact_dedup", r"""WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
  SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d""")
def _(spark, sf):
    digest = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    return exact.exact_groups(table(spark, sf, "documents"), carry=digest).withColumnRenamed("carried", "text_sha256")


@query("op2_html_extraction")
def _(spark, sf):
    out = html_text.extract_text(table(spark, sf, "pages"), kept=[F.col("page_id"), F.col("url")])
    return out.select("_kept.page_id", "_kept.url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op3_substring_dedup", r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
  g AS (SELECT doc_id, pos, word, md5(string_agg(word, ' ') OVER win) AS run, count(*) OVER win AS n FROM w
    WINDOW win AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
  r AS (SELECT run FROM g WHERE n = 35 GROUP BY run HAVING count(*) > 1),
  h AS (SELECT g.*, CASE WHEN n = 35 AND r.run IS NOT NULL THEN 1 ELSE 0 END AS hit FROM g LEFT JOIN r ON g.run = r.run),
  c AS (SELECT doc_id, pos, word, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM h),
  k AS (SELECT doc_id, sum(gone) AS gone, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""")
def _(spark, sf):
    out = substring.remove_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op4_language_id")
def _(spark, sf):
    return language.identify(table(spark, sf, "documents"))


@query("op5_ngram_jaccard")
def _(spark, sf):
    return jaccard.similar_documents(table(spark, sf, "documents"))


def _canonical_sql(text):
    text = f"replace(replace(lower(coalesce({text}, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    for a, b in licences.SIGNS:
        text = f"replace({text}, '{a}', '{b}')"
    text = f"regexp_replace({text}, '[^\\p{{L}}\\p{{N}}+\\n]+', ' ', 'g')"
    for a, b in licences.SPELLINGS:
        text = f"replace({text}, '{a}', '{b}')"
    text = f"regexp_replace({text}, '(?m)^ | $', '', 'g')"
    return f"regexp_replace({text}, '(?m)^copyright (copyright )?([0-9]|by )[^\\n]*(\\n|\\z)', '', 'g')"


def _licence_sql():
    known = ", ".join("('%s', '%s')" % (i, t.replace("'", "''")) for i, t in licences.LICENCES)
    flat = "trim(regexp_replace(%s, '\\n+', ' ', 'g'))"
    units = f"""SELECT id, c, list_filter(regexp_split_to_array(c, '\\n\\n+'), lambda p: length({flat % 'p'}) > 0) AS ps FROM %s"""
    return f"""WITH kt AS (SELECT i AS id, {_canonical_sql('t')} AS c FROM (VALUES {known}) AS v(i, t)), kp AS ({units % 'kt'}),
  kd AS (SELECT id, sha256({flat % 'c'}) AS digest FROM kp UNION ALL SELECT id, unnest(list_transform(ps, lambda p: sha256({flat % 'p'}))) FROM kp),
  k AS (SELECT digest, min(id) AS license_id FROM kd GROUP BY digest HAVING count(DISTINCT id) = 1),
  dt AS (SELECT doc_id AS id, {_canonical_sql('text')} AS c FROM documents), d AS ({units % 'dt'}),
  l AS (SELECT id, list_filter(flatten(list_transform(list_filter(ps, lambda p: contains(trim(p, chr(10)), chr(10))), lambda p: regexp_split_to_array(p, '\\n'))), lambda x: length(x) > 0) AS ls FROM d),
  u AS (SELECT id, 'text' AS unit, CAST(1 AS BIGINT) AS unit_no, {flat % 'c'} AS words FROM d
    UNION ALL SELECT id, 'paragraph', unnest(range(1, len(ps) + 1)), {flat % 'unnest(ps)'} FROM d WHERE len(ps) > 1
    UNION ALL SELECT id, 'line', unnest(range(1, len(ls) + 1)), unnest(ls) FROM l)
  SELECT id AS doc_id, unit, unit_no, license_id, digest FROM (SELECT id, unit, unit_no, sha256(words) AS digest FROM u WHERE words <> '') JOIN k USING (digest)"""


@query("op6_license_scan", _licence_sql())
def _(spark, sf):
    return licences.scan_licences(table(spark, sf, "documents"))


@query("op7_secret_scan")
def _(spark, sf):
    out = secrets.find_secrets(table(spark, sf, "documents"))
    found = F.col("found")
    counts = [secrets.count_of(found, k).alias(f"n_{k}") for k in secrets.BASE_KINDS]
    base = F.sha2(secrets.joined_spans(found, secrets.BASE_KINDS).cast("binary"), 256)
    return out.select("doc_id", *counts, base.alias("base_sha256"), secrets.joined_spans(found).alias("spans"))


@query("op8_mixing", r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
  c AS (SELECT *, source_size * 3 AS cap, sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER b, 0) AS words, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS share FROM s
    WINDOW b AS (ORDER BY source_size * 3 / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * max(CAST(words AS DOUBLE) / share) OVER ()) AS target FROM c),
  g AS (SELECT source, CAST(length(bin(size)) AS DOUBLE) AS m, sum(size) AS words FROM d GROUP BY ALL),
  a AS (SELECT source, coalesce(sum(words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(m * words) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM g WINDOW w AS (PARTITION BY source ORDER BY m DESC)),
  l AS (SELECT a.source, coalesce(max(CASE WHEN rest > 0 THEN (target - above * 3) / rest END), 0.0) AS level FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source GROUP BY a.source),
  r AS (SELECT d.doc_id, d.source, d.size, d.u, t.source_size, t.target, least(3.0::DOUBLE, length(bin(d.size)) * l.level) AS e
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN l ON d.source IS NOT DISTINCT FROM l.source),
  p AS (SELECT *, floor(e) AS whole, e - floor(e) AS p FROM r),
  v AS (SELECT *, CASE WHEN p > 0 THEN (u / (1.0 - u)) / (p / (1.0 - p)) END AS q, target - sum(whole * size) OVER (PARTITION BY source) AS quota FROM p),
  o AS (SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q / (1.0 + q) NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM v)
  SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN p > 0 AND upto - size / 2.0 <= quota THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM o""")
def _(spark, sf):
    return mixing.mix(table(spark, sf, "documents"), measure=mixing.digits(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_ann")
def _(spark, sf):
    return neighbours.nearest(table(spark, sf, "embeddings"))


@query("op10_sentencepiece")
def _(spark, sf):
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    coded = pieces.encode(table(spark, sf, "documents"), kept=[F.col("doc_id"), digest.alias("digest")])
    coded = coded.select(F.col("_kept.doc_id").alias("doc_id"), F.col("_kept.digest").alias("digest"), F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "ids")
    back = F.sha2(F.col("text").cast("binary"), 256)
    return pieces.decode(coded).select("doc_id", "n_pieces", "ids_hash", back.alias("text_sha256"), (back == F.col("digest")).alias("lossless"))


@query("op11_filter_audit", r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  e AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
  l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
  f AS (SELECT d.part, CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
      || CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]+', '', 'g')) > 5 * length(d.t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN d.doc_id > e.first_id THEN 'E' ELSE '' END AS fails, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
    FROM d JOIN e ON d.t = e.t LEFT JOIN l ON d.doc_id = l.doc_id),
  h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
  c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  o AS (SELECT c1.x || c2.x || c3.x || c4.x || c5.x AS filter_order FROM c AS c1, c AS c2, c AS c3, c AS c4, c AS c5
    WHERE len(list_distinct([c1.x, c2.x, c3.x, c4.x, c5.x])) = 5),
  s AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS x, substr(filter_order, 1, k - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
  g AS (SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS bad, fails = x AS only_this, before <> '' AND len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AS gone FROM h, s),
  r AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND bad), 0) AS removed, coalesce(sum(n) FILTER (gone AND bad), 0) AS redundant,
      coalesce(sum(n) FILTER (only_this), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND bad), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND bad), 0) AS toxic_lost
    FROM g GROUP BY part, filter_order, step, x)
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r""")
def _(spark, sf):
    return audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


def _manifest_sql():
    value = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')".format
    leaf = lambda n_chars: "sha256(" + " || ".join(map(value, ["doc_id", "source", "lang", n_chars, "text"])) + ")"
    climb = "SELECT tree, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM {0} WHERE n > 1 GROUP BY tree, lvl, i // 2".format
    sibling = "(n.i = CASE WHEN (d.{0} >> n.lvl) % 2 = 0 THEN (d.{0} >> n.lvl) + 1 ELSE (d.{0} >> n.lvl) - 1 END)".format
    return f"""WITH RECURSIVE b AS (SELECT doc_id, lang, {leaf("n_chars")} AS leaf, {leaf("n_chars + 1")} AS tampered FROM documents),
  bits AS (SELECT unnest(range(256)) AS c, 0 AS k, unnest(range(256)) AS v UNION ALL SELECT c, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
  crc_table AS (SELECT list(v ORDER BY c) AS t FROM bits WHERE k = 8),
  ids AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),
  crc AS (SELECT s, 0 AS k, CAST(4294967295 AS BIGINT) AS v FROM ids UNION ALL SELECT s, k + 1, xor(v >> 8, t[1 + xor(v & 255, ascii(substr(s, k + 1, 1)))]) FROM crc, crc_table WHERE k < length(s)),
  d AS (SELECT b.doc_id, coalesce('=' || lang, '') AS tree, leaf, CASE WHEN xor(crc.v, 4294967295) % 7 = 0 THEN tampered ELSE leaf END AS checked,
      row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM b LEFT JOIN crc ON crc.s = CAST(b.doc_id AS VARCHAR) AND crc.k = length(crc.s)),
  low AS (SELECT tree, 0 AS lvl, pos AS i, leaf AS h, n FROM d UNION ALL {climb("low")}),
  top AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS trees FROM low WHERE n = 1),
  high AS (SELECT '' AS tree, 0 AS lvl, place AS i, subroot AS h, trees AS n FROM top UNION ALL {climb("high")}),
  root AS (SELECT h AS root FROM high WHERE n = 1),
  j AS (SELECT d.*, top.subroot, top.place, row_number() OVER () AS r FROM d JOIN top USING (tree)),
  path AS (SELECT d.r, n.lvl, n.h AS sib, (d.pos >> n.lvl) % 2 AS side, 0 AS upper FROM j AS d JOIN low AS n ON n.tree = d.tree AND {sibling("pos")}
    UNION ALL SELECT d.r, n.lvl, n.h, (d.place >> n.lvl) % 2, 1 FROM j AS d JOIN high AS n ON {sibling("place")}),
  proof AS (SELECT r, sha256(string_agg(sib, '' ORDER BY upper, lvl)) AS proof_sha256 FROM path GROUP BY r),
  steps AS (SELECT DISTINCT tree, lvl, 0 AS upper FROM low WHERE n > 1 UNION ALL SELECT DISTINCT top.tree, high.lvl, 1 FROM high, top WHERE high.n > 1),
  plan AS (SELECT tree, lvl, upper, row_number() OVER (PARTITION BY tree ORDER BY upper, lvl) AS k FROM steps),
  todo AS (SELECT j.r, plan.k, path.sib, path.side FROM j JOIN plan USING (tree) LEFT JOIN path ON path.r = j.r AND path.lvl = plan.lvl AND path.upper = plan.upper),
  fold AS (SELECT r, 0 AS k, checked AS h FROM j UNION ALL SELECT fold.r, fold.k + 1, sha256(CASE WHEN todo.sib IS NULL THEN fold.h WHEN todo.side = 1 THEN todo.sib || fold.h ELSE fold.h || todo.sib END)
    FROM fold JOIN todo ON todo.r = fold.r AND todo.k = fold.k + 1),
  folded AS (SELECT r, arg_max(h, k) AS folded_root FROM fold GROUP BY r)
  SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM j JOIN folded USING (r) CROSS JOIN root LEFT JOIN proof USING (r)"""


@query("op12_merkle_manifest", _manifest_sql())
def _(spark, sf):
    seventh = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    return manifest.manifest(table(spark, sf, "documents"), altered={"n_chars": F.col("n_chars") + 1}, altered_rows=seventh)


@query("op13_lm_scoring")
def _(spark, sf):
    return ngram_model.score_texts(table(spark, sf, "documents"))
