"""The given tables seen as a register.

Each definition is one SELECT in the common subset of Spark SQL and DuckDB SQL, so
the engine and its oracle start from the same rows. ``<name>`` refers to a given
table or to another definition; ``ARR``, ``NOLIST`` and ``SHA`` stand for
the few functions the two spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
         "pages", "benchmark", "labels", "conversations"]

_CODE = "concat('RO', cast(ascii(seg) * 100 + length(seg) as string))"
_ID = "concat(kind, cast(k as string))"
_PUB = "date '2001-08-01'"
_NODATE = "cast(null as date)"

DEFINITIONS = {
    "base": """
        SELECT 'C' AS kind, c_custkey AS k, upper(c_name) AS name, c_nationkey AS nk, c_mktsegment AS seg FROM <customer>
        UNION ALL SELECT 'S', s_suppkey, upper(s_name), s_nationkey, 'VENDOR' FROM <supplier>
        UNION ALL SELECT 'P', p_partkey, CASE WHEN p_partkey % 12 = 0 THEN concat(upper(p_name), '''S - Shop & Café')
                                              ELSE upper(p_name) END,
                         cast(p_partkey % 25 as int), p_type FROM <part>""",
    "orgs": f"""
        SELECT {_ID} AS ods_code, name, CASE WHEN k % 7 = 0 THEN 'inactive' ELSE 'active' END AS status,
               CASE WHEN k % 3 = 0 THEN 'site' ELSE 'org' END AS record_class,
               CASE WHEN kind = 'P' AND k % 50 = 0 THEN ARR('RO177', 'RO57') WHEN k % 5 = 0 THEN ARR('RO177', {_CODE})
                    ELSE ARR({_CODE}) END AS role_codes,
               CASE WHEN kind = 'P' AND k % 50 = 0 THEN ARR('COST CENTRE', 'FOUNDATION FLAG')
                    WHEN k % 5 = 0 THEN ARR('COST CENTRE', seg) ELSE ARR(seg) END AS role_names,
               CASE WHEN k % 97 = 0 THEN '' WHEN kind = 'P' AND k % 50 = 0 THEN 'RO177' ELSE {_CODE} END AS primary_role_code,
               concat(cast(k as string), ' HIGH STREET, ', n_name) AS address,
               CASE WHEN k % 17 = 0 THEN NULL WHEN k % 10 = 3 THEN concat(n_name, ' EAST')
                    WHEN k % 10 = 7 THEN concat(n_name, '-Queen''s WEST') ELSE n_name END AS town,
               r_name AS county,
               CASE WHEN k % 29 = 0 THEN NULL
                    WHEN k % 23 = 0 THEN concat(chr(65 + nk), cast(k % 9 + 1 as string), cast(k % 10 as string), 'XY')
                    ELSE concat(chr(65 + nk), cast(k % 9 + 1 as string), CASE WHEN k % 8 = 0 THEN 'A' ELSE '' END, ' ',
                                cast(k % 10 as string), 'XY') END AS postcode,
               CASE WHEN nk % 4 = 0 THEN 'ENGLAND' WHEN nk % 4 = 1 THEN 'SCOTLAND' WHEN nk % 4 = 2 THEN 'WALES'
                    ELSE 'NORTHERN IRELAND' END AS country,
               CASE WHEN k % 6 = 0 THEN NULL ELSE cast(1000000 + k as string) END AS uprn,
               CASE WHEN k % 4 = 0 THEN NULL ELSE concat('0', cast(700000 + k as string)) END AS telephone,
               CASE WHEN k % 4 = 1 THEN concat('http://', lower(kind), cast(k as string), '.example') ELSE NULL END AS website,
               CASE WHEN k % 9 < 4 THEN date '1990-01-15' + cast(k % 4000 as int) ELSE NULL END AS legal_start,
               CASE WHEN k % 11 = 0 THEN date '1998-01-01' WHEN k % 13 = 0 THEN date '2005-01-01'
                    WHEN k % 26 = 5 THEN date '2001-05-01' ELSE NULL END AS legal_end,
               CASE WHEN k % 31 = 0 THEN date '1900-01-01' WHEN k % 9 = 1 THEN date '1990-01-15' + cast(k % 4000 as int)
                    ELSE date '1990-01-01' + cast(k % 4000 as int) END AS operational_start,
               CASE WHEN k % 77 = 0 THEN NULL WHEN k % 7 = 0 THEN date '1999-06-01' + cast(k % 500 as int)
                    WHEN k % 41 = 0 THEN date '2002-01-01' + cast(k % 300 as int) ELSE NULL END AS operational_end,
               date '2000-01-01' + cast(k % 365 as int) AS last_changed, {_PUB} AS publication_date
        FROM <base> JOIN <nation> ON nk = n_nationkey JOIN <region> ON n_regionkey = r_regionkey""",
    "roles": f"""
        SELECT ods_code, role_code, role_name, is_primary, role_status, {_NODATE} AS legal_start, {_NODATE} AS legal_end,
               operational_start, operational_end, role_id, {_PUB} AS publication_date
        FROM (
          SELECT {_ID} AS ods_code, {_CODE} AS role_code, CASE WHEN k % 301 = 9 THEN lower(seg) ELSE seg END AS role_name,
                 true AS is_primary, CASE WHEN k % 7 = 0 THEN 'inactive' ELSE 'active' END AS role_status,
                 date '1991-01-01' + cast(k % 3000 as int) AS operational_start,
                 CASE WHEN k % 7 = 0 AND k % 21 <> 0 THEN date '1999-07-01' + cast(k % 700 as int) ELSE NULL END AS operational_end,
                 concat({_ID}, '-', {_CODE}) AS role_id
          FROM <base> WHERE NOT (kind = 'P' AND k % 50 = 0) AND k % 83 <> 1
          UNION ALL
          SELECT {_ID}, 'RO177', 'COST CENTRE', kind = 'P' AND k % 50 = 0, 'active',
                 date '2000-01-01' + cast(k % 400 as int), NULL, concat({_ID}, '-RO177')
          FROM <base> WHERE k % 5 = 0
          UNION ALL
          SELECT {_ID}, 'RO57', 'FOUNDATION FLAG', false, 'active', date '1995-01-01', NULL, concat({_ID}, '-RO57')
          FROM <base> WHERE kind = 'P' AND k % 50 = 0
          UNION ALL
          SELECT {_ID}, {_CODE}, seg, true, 'inactive', date '1989-01-01', date '1990-12-31', concat({_ID}, '-old')
          FROM <base> WHERE k % 19 = 0
          UNION ALL
          SELECT concat('X', cast(k as string)), 'RO404', 'NO SUCH ROLE', true, 'active', date '1995-01-01', NULL,
                 concat('X', cast(k as string), '-RO404')
          FROM <base> WHERE kind = 'C' AND k % 331 = 5
        ) r""",
    "vocab": f"""
        SELECT DISTINCT {_CODE} AS role_code, seg AS role_name FROM <base>
        UNION ALL SELECT role_code, role_name FROM (
          SELECT DISTINCT 'RO177' AS role_code, 'COST CENTRE' AS role_name FROM <region>
          UNION ALL SELECT DISTINCT 'RO57', 'FOUNDATION FLAG' FROM <region>
          UNION ALL SELECT DISTINCT 'RO999', 'UNUSED ROLE' FROM <region>) x""",
    "relationships": f"""
        SELECT concat('S', cast(l_suppkey as string)) AS source_code, concat('P', cast(l_partkey as string)) AS target_code,
               CASE l_returnflag WHEN 'A' THEN 'RE4' WHEN 'N' THEN 'RE6' ELSE 'RE5' END AS rel_code,
               CASE l_returnflag WHEN 'A' THEN 'IS COMMISSIONED BY' WHEN 'N' THEN 'IS OPERATED BY'
                                 ELSE 'IS LOCATED IN THE GEOGRAPHY OF' END AS rel_name,
               CASE l_linestatus WHEN 'O' THEN 'active' ELSE 'inactive' END AS rel_status,
               {_NODATE} AS legal_start, {_NODATE} AS legal_end, cast(l_shipdate as date) AS operational_start,
               CASE l_linestatus WHEN 'O' THEN NULL ELSE cast(l_shipdate as date) + 100 END AS operational_end,
               concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-',
                      cast(l_suppkey as string)) AS rel_id, {_PUB} AS publication_date
        FROM <lineitem>
        UNION ALL
        SELECT concat('P', cast(p_partkey as string)),
               CASE WHEN p_partkey % 211 = 7 THEN concat('X', cast(p_partkey as string))
                    WHEN p_partkey % 40 = 9 THEN concat('P', cast(p_partkey as string))
                    ELSE concat('C', cast(p_partkey % 100 as string)) END,
               CASE WHEN p_partkey % 6 = 0 THEN 'RE8' ELSE 'RE4' END,
               CASE WHEN p_partkey % 6 = 0 THEN 'IS PARTNER TO' ELSE 'IS COMMISSIONED BY' END, 'active',
               {_NODATE}, {_NODATE}, date '1996-03-01' + cast(p_partkey % 900 as int), NULL,
               concat('p', cast(p_partkey as string)), {_PUB}
        FROM <part>""",
    "successions": f"""
        SELECT concat('S', cast(a as string)) AS predecessor_code, concat('S', cast(b as string)) AS successor_code,
               legal_start, succession_id, {_PUB} AS publication_date
        FROM (
          SELECT x.s_suppkey AS a, y.s_suppkey AS b, date '1995-01-01' + cast(x.s_suppkey % 2000 as int) AS legal_start,
                 concat('n', cast(x.s_suppkey as string)) AS succession_id
          FROM <supplier> x JOIN <supplier> y ON y.s_suppkey = x.s_suppkey + 1 + x.s_nationkey
          UNION ALL
          SELECT s_suppkey, s_suppkey - s_suppkey % 10, CASE WHEN s_suppkey % 8 = 3 THEN NULL ELSE date '1996-06-01' END,
                 concat('m', cast(s_suppkey as string))
          FROM <supplier> WHERE s_suppkey % 4 = 3
          UNION ALL
          SELECT s_suppkey, s_suppkey, date '1997-01-01', concat('z', cast(s_suppkey as string))
          FROM <supplier> WHERE s_suppkey % 40 = 0
        ) e""",
    "snapshots": """
        SELECT concat('U', cast(user_id as string)) AS ods_code, upper(max_by(event_type, event_id)) AS name,
               CASE WHEN max_by(event_type, event_id) = 'error' THEN 'inactive' ELSE 'active' END AS status,
               concat('N', cast(max(event_id) % 9 + 1 as string), ' ', cast(count(*) % 5 as string), 'AA') AS postcode,
               CASE WHEN min(event_id) % 4 = 0 THEN NULL ELSE concat('T', cast(min(event_id) % 5 as string)) END AS town,
               concat('RO', cast(count(*) % 3 as string)) AS primary_role_code,
               CASE WHEN max(event_id) % 3 = 0 THEN cast(ts as date) ELSE date '2024-01-01' END AS last_changed,
               CASE count(*) % 3 WHEN 0 THEN NOLIST WHEN 1 THEN ARR('A') ELSE ARR('A', 'B') END AS successor_codes,
               date '2023-12-01' + cast(user_id % 60 as int) AS operational_start,
               CASE WHEN user_id % 5 = 0 THEN date '2024-01-10' + cast(user_id % 20 as int) ELSE NULL END AS operational_end,
               cast(ts as date) AS publication_date
        FROM <events> GROUP BY cast(ts as date), user_id""",
    "rel_series": """
        SELECT concat('S', cast(l_suppkey as string)) AS source_code, concat('P', cast(l_partkey as string)) AS target_code,
               CASE l_returnflag WHEN 'A' THEN 'RE4' WHEN 'N' THEN 'RE6' ELSE 'RE5' END AS rel_code,
               CASE l_linestatus WHEN 'O' THEN 'active' ELSE 'inactive' END AS rel_status,
               concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-',
                      cast(l_suppkey as string)) AS rel_id,
               cast(date_trunc('year', l_shipdate) as date) AS publication_date
        FROM <lineitem>""",
    "snap_old": """
        SELECT concat('C', cast(o_custkey as string)) AS ods_code,
               concat('CLIENT ', cast(o_custkey as string), CASE WHEN max(o_orderkey) % 11 = 0 THEN ' LTD' ELSE '' END) AS name,
               CASE WHEN max_by(o_orderstatus, o_orderkey) = 'F' THEN 'inactive' ELSE 'active' END AS status,
               max_by(o_orderpriority, o_orderkey) AS role,
               CASE WHEN max(o_orderkey) % 5 = 0 THEN NULL ELSE concat('TOWN ', cast(max(o_orderkey) % 4 as string)) END AS town,
               CASE WHEN max(o_orderkey) % 7 = 0 THEN NULL ELSE concat('N', cast(max(o_orderkey) % 3 + 1 as string), ' 1AA') END
                 AS postcode,
               concat('tel:', cast(max(o_orderkey) % 2 as string)) AS contacts
        FROM <orders> WHERE o_orderdate < timestamp '1998-01-01 00:00:00' AND o_custkey % 9 <> 4 GROUP BY o_custkey""",
    "catalog_releases": """
        SELECT cast(cast(o_orderdate as date) as string) AS release,
               concat('sha256:', SHA(cast(cast(o_orderdate as date) as string))) AS source_hash,
               cast(sum(o_orderkey) + 1 as bigint) AS source_bytes,
               CASE WHEN count(*) % 3 = 0 THEN ARR('late-file') WHEN count(*) % 7 = 0 THEN ARR('two-full-files', 'Bad Issue')
                    ELSE NOLIST END AS issues
        FROM <orders> GROUP BY cast(o_orderdate as date)""",
    "catalog_datasets": """
        SELECT release, concat(release, '_0.', cast(a as string), '.', cast(b as string)) AS version,
               concat('sha256:', SHA(concat(release, cast(a as string), cast(b as string)))) AS manifest_digest, bytes,
               concat('0.2.', cast(b as string)) AS tool_version,
               substr(SHA(cast(low as string)), 1, CASE WHEN low % 101 = 7 THEN 39 ELSE 40 END) AS tool_git_sha,
               CASE WHEN low % 13 = 0 THEN concat('10.1/', cast(low as string)) ELSE NULL END AS doi,
               CASE WHEN low % 6 = 1 OR release > '2001-07-20' THEN 'bad build' ELSE NULL END AS withdrawn, low
        FROM (SELECT cast(cast(o_orderdate as date) as string) AS release, o_orderkey % 12 AS a, o_orderkey % 5 AS b,
                     cast(sum(o_custkey) as bigint) AS bytes, min(o_orderkey) AS low
              FROM <orders>
              GROUP BY cast(cast(o_orderdate as date) as string), o_orderkey % 12, o_orderkey % 5) d""",
    "new_releases": """
        SELECT release, CASE WHEN source_bytes % 50 = 3 THEN concat('sha256:', SHA('changed')) ELSE source_hash END AS source_hash,
               CASE WHEN source_bytes % 50 = 4 THEN source_bytes + 1 ELSE source_bytes END AS source_bytes,
               CASE WHEN source_bytes % 4 = 0 THEN ARR('found-later') ELSE issues END AS issues
        FROM <catalog_releases>""",
    "old_releases": "SELECT * FROM <catalog_releases> WHERE source_bytes % 10 <> 7",
    "new_datasets": """
        SELECT release, version, CASE WHEN low % 60 = 0 THEN concat('sha256:', SHA('changed')) ELSE manifest_digest END
                 AS manifest_digest, CASE WHEN low % 60 = 3 THEN bytes + 1 ELSE bytes END AS bytes, tool_version, tool_git_sha,
               CASE WHEN low % 13 = 1 THEN 'late-doi' ELSE doi END AS doi,
               CASE WHEN low % 10 = 2 THEN 'found bad later' ELSE withdrawn END AS withdrawn, low
        FROM <catalog_datasets>""",
    "old_datasets": "SELECT * FROM <catalog_datasets> WHERE low % 10 <> 7",
    "raw_records": f"""
        SELECT {_ID} AS code, 0 AS file_index, k % 6 = 0 AS ref_only, cast(date '1990-01-01' + cast(k % 3000 as int) as string)
                 AS op_start, name FROM <base> WHERE k % 4 <> 1
        UNION ALL
        SELECT {_ID}, 1, k % 5 = 0, cast(date '1985-01-01' + cast(k % 2000 as int) as string), concat(name, ' (ARCHIVE)')
        FROM <base> WHERE k % 3 <> 1
        UNION ALL
        SELECT {_ID}, 0, false, CASE WHEN k % 500 = 2 THEN NULL WHEN k % 500 = 3 THEN
                 cast(date '1990-01-01' + cast(k % 3000 as int) as string) ELSE
                 cast(date '1994-01-01' + cast(k % 3000 as int) as string) END, concat(name, ' (AGAIN)')
        FROM <base> WHERE k % 50 IN (2, 3)""",
    "source_files": """
        SELECT release, date '1995-01-02' + cast(release % 3 as int) AS release_date, kind, file_name,
               CASE WHEN k % 11 = 0 THEN NULL ELSE date '1995-01-01' + cast(k % 4 as int) END AS publication_date
        FROM (SELECT cast(floor(o_orderkey / 32.0) as bigint) AS release, o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 THEN 'full' ELSE 'archive' END AS kind,
                     concat('file', cast(o_orderkey as string), '.xml') AS file_name FROM <orders>) x""",
    "manifests": """
        SELECT release, file_name, CASE WHEN k % 1000 = 0 THEN NULL WHEN k % 700 = 1 THEN '2001-13-01'
                 WHEN k % 50 = 3 THEN cast(date '1995-01-02' + cast(release % 900 as int) as string)
                 ELSE cast(date '1995-01-01' + cast(release % 900 as int) as string) END AS publication_date,
               cast(10 as bigint) AS record_count
        FROM (SELECT cast(floor(o_orderkey / 32.0) as bigint) AS release, o_orderkey AS k,
                     concat('file', cast(o_orderkey as string), '.xml') AS file_name FROM <orders>) x""",
}
_snap_new = DEFINITIONS["snap_old"].replace("o_orderdate < timestamp '1998-01-01", "o_orderdate >= timestamp '1998-01-01").replace("% 9 <> 4", "% 8 <> 3")
DEFINITIONS["snap_new"] = _snap_new

_XML_ROW = f"""
    SELECT {_ID} AS code, kind, k, @FILE AS file_index, @STUB AS ref_only, @NAME AS name,
           CASE WHEN k % 3 = 0 THEN 'RC2' ELSE 'RC1' END AS record_class,
           CASE WHEN k % 45 = 0 THEN NULL WHEN k % 7 = 0 THEN 'Inactive' ELSE 'Active' END AS status,
           cast(date '@EPOCH' + cast(k % 3000 as int) as string) AS op_start,
           CASE WHEN k % 121 = 0 THEN '1999-02-30' WHEN k % 77 = 0 THEN NULL WHEN k % 7 = 0 THEN
             cast(date '1992-06-01' + cast(k % 900 as int) as string) ELSE NULL END AS op_end,
           CASE WHEN k % 9 < 4 THEN concat('1996-', cast(k % 9 + 1 as string), '-', cast(k % 28 + 1 as string)) ELSE NULL END AS legal_start,
           CASE WHEN k % 18 = 1 THEN '1995-01-01' ELSE NULL END AS legal_end,
           concat(cast(k as string), ' HIGH STREET') AS addr1, CASE WHEN k % 4 = 0 THEN '  ' ELSE 'THE ARCADE' END AS addr2,
           CASE WHEN k % 17 = 0 THEN NULL ELSE concat('TOWN ', cast(nk as string)) END AS town,
           CASE WHEN k % 29 = 0 THEN NULL ELSE concat('N', cast(k % 9 + 1 as string), ' ', cast(k % 10 as string), 'XY') END AS postcode,
           CASE WHEN k % 4 = 0 THEN NULL ELSE concat('0', cast(700000 + k as string)) END AS tel,
           CASE WHEN k % 4 = 1 THEN concat('HTTP://', kind, cast(k as string), '.Example') ELSE NULL END AS http,
           {_CODE} AS role1, CASE WHEN k % 14 = 0 THEN 'Inactive' ELSE 'Active' END AS role1_status,
           CASE WHEN k % 5 = 1 THEN 'RO177' ELSE NULL END AS role2,
           CASE WHEN k % 10 = 1 THEN 'Inactive' ELSE 'Active' END AS role2_status,
           CASE WHEN k % 97 = 5 THEN concat('X', cast(k as string)) ELSE concat('C', cast(k % 100 as string)) END AS rel1_target,
           CASE WHEN k % 3 = 2 THEN concat('S', cast(k % 50 as string)) ELSE NULL END AS rel2_target,
           CASE WHEN k % 2 = 0 THEN 'Inactive' ELSE 'Active' END AS rel2_status,
           CASE WHEN k % 40 = 8 THEN 'RO7009' ELSE NULL END AS rel1_role,
           CASE WHEN kind = 'S' AND k % 3 = 2 THEN 'Predecessor' WHEN kind = 'S' AND k % 3 = 1 THEN 'Successor' ELSE NULL END AS succ_type,
           CASE WHEN k % 20 = 1 THEN concat('Z', cast(k as string)) ELSE concat('S', cast(k % 40 as string)) END AS succ_target,
           concat('su', cast(k - k % 4 as string)) AS succ_id
    FROM <base>"""
DEFINITIONS["xml_src"] = (
    _XML_ROW.replace("@FILE", "0").replace("@STUB", "k % 6 = 0").replace("@NAME", "name").replace("@EPOCH", "1990-01-01")
    + " UNION ALL "
    + _XML_ROW.replace("@FILE", "1").replace("@STUB", "(k % 6 <> 0 AND k % 5 = 0)").replace("@NAME", "concat(name, ' (ARCHIVE)')")
    .replace("@EPOCH", "1985-01-01") + " WHERE k % 3 <> 1 AND k % 30 <> 0")
# the records a merge of the two files keeps
DEFINITIONS["xml_kept"] = """
    SELECT * FROM <xml_src> WHERE (file_index = 0 AND (k % 6 <> 0 OR k % 30 = 0)) OR (file_index = 1 AND k % 6 = 0)"""

_SPARK = {"ARR(": "array(", "NOLIST": "cast(array() as array<string>)"}
_DUCK = {"ARR(": "list_value(", "NOLIST": "cast([] as varchar[])", "SHA(": "sha256("}


def _sha_spark(sql: str) -> str:
    """``SHA(x)`` is ``sha2(x, 256)`` in Spark; arguments hold balanced parentheses."""
    while (at := sql.find("SHA(")) >= 0:
        depth, i = 0, at + 3
        while True:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if depth == 0:
                break
            i += 1
        sql = f"{sql[:at]}sha2({sql[at + 4:i]}, 256){sql[i + 1:]}"
    return sql


def _refs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"<(\w+)>", sql)))


class Tables:
    """The given and adapted tables of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in GIVEN and name not in DEFINITIONS):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._build(name)
        return self._made[name]

    def _build(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        sql = DEFINITIONS[name]
        deps = {d: getattr(self, d) for d in _refs(sql)}
        sql = _sha_spark(re.sub(r"<(\w+)>", r"{\1}", sql))
        for a, b in _SPARK.items():
            sql = sql.replace(a, b)
        return self.spark.sql(sql, **deps)


def _duck_text(sql: str) -> str:
    for a, b in _DUCK.items():
        sql = sql.replace(a, b)
    return re.sub(r"<(\w+)>", r"\1", sql)


def oracle(sql: str) -> str:
    """DuckDB text of a query over ``<name>`` tables, with the definitions it needs in front."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in DEFINITIONS and name not in order:
            for d in _refs(DEFINITIONS[name]):
                need(d)
            order.append(name)

    for name in _refs(sql):
        need(name)
    ctes = [f"{n} AS ({_duck_text(DEFINITIONS[n])})" for n in order]
    text = _duck_text(sql).strip()
    if not ctes:
        return text
    if text.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + text[len("WITH RECURSIVE "):]
    if text.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + text[len("WITH "):]
    return "WITH " + ", ".join(ctes) + " " + text
