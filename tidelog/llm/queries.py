"""Queries of the problems of training data: 2, 3, 6, 7, 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import mixing, seen, stuffing, survivors, tokens
from tidelog.session import checkpoint, table


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.best_records(survivors.node_records(table(spark, sf_dir, "kv_sst")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.by_field(_best(spark, sf_dir).where("n >= 2"))


def p2_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node record per key, each field with its best known value."""
    return _best(spark, sf_dir).select("k", *[F.col(f"{f}.val").alias(f) for f in survivors.FIELDS])


#: Fields that are ordered by the record's `stamp`.
STAMPED = ("hash", "parent", "size", "owner")


def by_stamp(kv_sst: DataFrame) -> DataFrame:
    """best_records of STAMPED by the records' own `stamp`, which many lack: those are placed by learned
    precedence. Rows not newer by `seq` than the key's newest tombstone supply nothing."""
    rows = survivors.after_tombstones(survivors.node_records(kv_sst))
    rows = checkpoint(rows.select("k", F.unix_micros(F.try_to_timestamp("stamp")).alias("at"), *STAMPED))
    return survivors.best_records(rows, "k", "at", STAMPED, None)


def p2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current hash, parent, size and owner of each key by `stamp`; a key of which nothing is left has no row."""
    return by_stamp(table(spark, sf_dir, "kv_sst")).select("k", *[F.col(f"{f}.val").alias(f) for f in STAMPED])


def p2_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current owner by `stamp`, and that stamp in microseconds, null if the owner is told by precedence alone."""
    best = by_stamp(table(spark, sf_dir, "kv_sst"))
    return best.where("owner is not null").select("k", F.col("owner.val").alias("owner"), F.col("owner.t").alias("stamp_us"))


def _seen(spark: SparkSession, sf_dir: str, audit: bool) -> seen.Seen:
    return seen.seen_before(table(spark, sf_dir, "kv_sst"), table(spark, sf_dir, "key_probe"), audit=audit)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir, False).rows.select("in_id")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir, True).report()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p6_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), offsets=True)


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.decode(p6_ids(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    target = table(spark, sf_dir, "mix_target")
    sizes = mixing.sized(table(spark, sf_dir, "documents"), target)
    rated = mixing.rates(sizes, target)
    return mixing.mix(sizes, rated), rated


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return stuffing.stuffed_pages(documents, model=stuffing.fit(documents, table(spark, sf_dir, "page_label")))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return stuffing.non_prose_share(documents, model=stuffing.fit(documents, table(spark, sf_dir, "page_label")))


QUERIES = {"p2_found": p2_found, "p2_record": p2_record, "p2_owner": p2_owner, "p2_current": p2_current, "p3_found": p3_found, "p3_report": p3_report, "p6_ids": p6_ids, "p6_offsets": p6_offsets, "p6_decoded": p6_decoded, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_shares": p8_shares}

_UNKNOWN = ", ".join(f"'{x}'" for x in survivors.UNKNOWN)
_JSON = " ".join(f"WHEN fld = '{f}' THEN json_extract_string(j, '$.{f}')" for f in survivors.FIELDS)
_PAIRS = " ".join(f"WHEN fld = '{f}' THEN regexp_extract(t, '(?:^|;)\\s*{f}\\s*=([^;]*);', 1)" for f in survivors.FIELDS)
_KNOWN = f"""val IS NOT NULL AND lower(val) NOT IN ({_UNKNOWN}) AND CASE fld
               WHEN 'hash' THEN regexp_full_match(val, '[0-9A-Fa-f]{{16}}') AND NOT regexp_full_match(val, '0+')
               WHEN 'parent' THEN val LIKE 'tree/_%'
               WHEN 'stamp' THEN regexp_matches(val, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?Z$') AND TRY_CAST(val AS TIMESTAMPTZ) IS NOT NULL AND val >= '2019'
               WHEN 'size' THEN regexp_full_match(val, '0*[1-9][0-9]*') ELSE true END"""
_P2 = f"""
  WITH e AS (SELECT k, seq, trim(v) AS t, v IS NULL AS dead FROM kv_sst WHERE length(k) > 0),
       g AS (SELECT k, count(*) AS n, max(CASE WHEN dead THEN seq END) AS tomb FROM e GROUP BY k),
       o AS (SELECT k, seq, fld, t, CASE WHEN t LIKE '{{%}}' AND json_valid(t) THEN t::json END AS j
             FROM e, (SELECT unnest(['hash', 'parent', 'stamp', 'size', 'owner']) AS fld) WHERE NOT dead),
       x AS (SELECT k, seq, fld, trim(CASE WHEN j IS NOT NULL THEN CASE {_JSON} END WHEN t LIKE '%;' AND t NOT LIKE '{{%' THEN CASE {_PAIRS} END END) AS val FROM o),
       y AS (SELECT * FROM x WHERE {_KNOWN}),
       b AS (SELECT k, fld, max(y.seq) AS seq FROM y JOIN g USING (k) WHERE tomb IS NULL OR y.seq > tomb GROUP BY k, fld)"""

_OF = "('hash', 'parent', 'size', 'owner')"
#: by_stamp: (k, fld, val, at) of each key's field, at null where precedence decided; and the keys that have a row left.
_BY_STAMP = f"""
  WITH RECURSIVE e AS (SELECT row_number() OVER () AS rid, k, seq, trim(v) AS t, v IS NULL AS dead FROM kv_sst WHERE length(k) > 0),
       g AS (SELECT k, max(CASE WHEN dead THEN seq END) AS tomb FROM e GROUP BY k),
       l AS (SELECT e.* FROM e JOIN g USING (k) WHERE NOT dead AND (tomb IS NULL OR seq IS NULL OR seq > tomb)),
       o AS (SELECT rid, k, fld, t, CASE WHEN t LIKE '{{%}}' AND json_valid(t) THEN t::json END AS j FROM l, (SELECT unnest(['hash', 'parent', 'stamp', 'size', 'owner']) AS fld)),
       x AS (SELECT rid, k, fld, trim(CASE WHEN j IS NOT NULL THEN CASE {_JSON} END WHEN t LIKE '%;' AND t NOT LIKE '{{%' THEN CASE {_PAIRS} END END) AS val FROM o),
       y AS (SELECT * FROM x WHERE {_KNOWN}),
       s AS (SELECT rid, epoch_us(CAST(val AS TIMESTAMPTZ)) AS us FROM y WHERE fld = 'stamp'),
       w AS (SELECT k, fld, val, us FROM y LEFT JOIN s USING (rid) WHERE fld IN {_OF}),
       timed AS (SELECT k, fld, us, max(val) AS val FROM w WHERE us IS NOT NULL GROUP BY ALL),
       mv AS (SELECT fld, lag(val) OVER (PARTITION BY k, fld ORDER BY us) AS a, val AS b FROM timed),
       net AS (SELECT fld, a, b, count(*) AS n FROM mv WHERE a <> b GROUP BY ALL),
       ed AS (SELECT p.fld, p.a, p.b FROM net p LEFT JOIN net q ON p.fld = q.fld AND p.a = q.b AND p.b = q.a WHERE p.n - coalesce(q.n, 0) >= {survivors.SUPPORT}),
       reach AS (SELECT fld, a, b FROM ed UNION SELECT r.fld, r.a, ed.b FROM reach r JOIN ed ON r.fld = ed.fld AND r.b = ed.a),
       node AS (SELECT fld, a AS v FROM ed UNION SELECT fld, b FROM ed),
       comp AS (SELECT n.fld, v, least(v, coalesce(min(r.b), v)) AS c FROM node n LEFT JOIN (SELECT r.* FROM reach r JOIN reach q ON r.fld = q.fld AND r.a = q.b AND r.b = q.a) r ON r.fld = n.fld AND r.a = v GROUP BY n.fld, v),
       dag AS (SELECT DISTINCT ed.fld, p.c AS a, q.c AS b FROM ed JOIN comp p ON p.fld = ed.fld AND p.v = ed.a JOIN comp q ON q.fld = ed.fld AND q.v = ed.b WHERE p.c <> q.c),
       depth AS (SELECT fld, c AS v, 0 AS n FROM comp UNION SELECT d.fld, dag.b, d.n + 1 FROM depth d JOIN dag ON d.fld = dag.fld AND d.v = dag.a),
       near AS (SELECT fld, a, b FROM ed UNION SELECT fld, b, a FROM ed UNION SELECT n.fld, n.a, m.b FROM near n JOIN (SELECT fld, a, b FROM ed UNION SELECT fld, b, a FROM ed) m ON n.fld = m.fld AND n.b = m.a),
       part AS (SELECT fld, a AS v, min(least(a, b)) AS part FROM near GROUP BY fld, a),
       rk AS (SELECT c.fld, c.v AS val, max(n) AS rank, any_value(part) AS part FROM comp c JOIN depth d ON d.fld = c.fld AND d.v = c.c JOIN part p ON p.fld = c.fld AND p.v = c.v GROUP BY c.fld, c.v),
       h AS (SELECT * FROM (SELECT k, fld, us, val, row_number() OVER (PARTITION BY k, fld ORDER BY us DESC) AS rn FROM timed) z WHERE rn = 1),
       hr AS (SELECT h.k, h.fld, h.us, h.val, rank, part FROM h LEFT JOIN rk ON rk.fld = h.fld AND rk.val = h.val),
       lo AS (SELECT w.k, w.fld, w.val, count(*) AS c, any_value(rank) AS rank, any_value(part) AS part FROM w LEFT JOIN rk ON rk.fld = w.fld AND rk.val = w.val WHERE us IS NULL GROUP BY w.k, w.fld, w.val),
       pick AS (SELECT * FROM (SELECT lo.k, lo.fld, lo.val, row_number() OVER (PARTITION BY lo.k, lo.fld ORDER BY coalesce(lo.rank, 0) DESC, c DESC, lo.val DESC) AS rn
                FROM lo LEFT JOIN hr ON hr.k = lo.k AND hr.fld = lo.fld WHERE hr.val IS NULL OR lo.part = hr.part AND lo.rank > hr.rank) z WHERE rn = 1),
       best AS (SELECT coalesce(p.k, h.k) AS k, coalesce(p.fld, h.fld) AS fld, coalesce(p.val, h.val) AS val, CASE WHEN p.val IS NULL THEN us END AS us FROM pick p FULL OUTER JOIN h ON p.k = h.k AND p.fld = h.fld)"""

SQL = {
    "p2_owner": f"{_BY_STAMP} SELECT k, val AS owner, us AS stamp_us FROM best WHERE fld = 'owner'",
    "p2_current": f"""{_BY_STAMP} SELECT l.k, {", ".join(f"max(CASE WHEN fld = '{f}' THEN val END) AS {f}" for f in STAMPED)}
  FROM (SELECT DISTINCT k FROM l) l LEFT JOIN best ON best.k = l.k GROUP BY l.k""",
    "p2_found": f"{_P2} SELECT b.k, b.fld, b.seq FROM b JOIN g USING (k) WHERE n >= 2",
    "p2_record": f"""{_P2}, z AS (SELECT k, fld, max(val) AS val FROM y JOIN b USING (k, fld, seq) GROUP BY k, fld)
  SELECT g.k, {", ".join(f"max(CASE WHEN fld = '{f}' THEN val END) AS {f}" for f in survivors.FIELDS)} FROM g LEFT JOIN z USING (k) GROUP BY g.k""",
    "p3_found": """
  SELECT in_id FROM key_probe p WHERE length(k) > 0 AND (k IN (SELECT k FROM kv_sst WHERE k IS NOT NULL)
    OR in_id > (SELECT min(in_id) FROM key_probe q WHERE q.k = p.k))""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
