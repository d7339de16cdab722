"""The model's tables, made from the given ones.

Each adapter is a list of column expressions that Spark and DuckDB both read, so
the oracle SQL starts from the same rows as the Spark queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ORDERS = "orders join customer on o_custkey = c_custkey"

#: name -> (columns, from-clause, where-clause)
ADAPTERS: dict[str, tuple[list[str], str, str]] = {
    "calls": (["o_orderkey as path", "'Call ' || o_orderkey as title", "cast(o_orderdate as date) as day", "o_orderkey % 90 + 1 as duration_min", "o_orderkey * 7 % 1440 as start_min", "c_mktsegment as grp", "case when o_orderpriority = '5-LOW' then 'note' else 'call' end as kind", "c_name as participant"], _ORDERS, ""),
    "mentions": (["l_partkey as entity_id", "l_orderkey as path", "l_linenumber * 1000 as start_ms"], "lineitem", "l_partkey % 50 <> 7"),
    "registry": (["p_partkey as id", "case when p_partkey % 5 = 0 then split_part(p_name, ' ', 1) else p_name end as name", "case p_partkey % 3 when 0 then 'person' when 1 then 'org' else 'term' end as kind", "p_brand as grp", "p_partkey % 2 = 0 as confirmed"], "part", ""),
    "registry_people": (["c_custkey as id", "c_name as name", "'person' as kind", "c_mktsegment as grp", "c_custkey % 3 <> 0 as confirmed"], "customer", ""),
    "registry_aliases": (["p_partkey as id", "upper(split_part(p_name, ' ', 2)) || ' of ' || p_brand as alias"], "part", "p_partkey % 4 = 0"),
    "registry_merges": (["cast(floor(p_partkey / 2) as bigint) as a", "p_partkey as b"], "part", "p_partkey % 6 = 0"),
    "people_aliases": (["c_custkey as id", "replace(c_name, 'Customer#', 'CUST ') as alias"], "customer", "c_custkey % 4 <> 0"),
    "people_merges": (["cast(floor(c_custkey / 2) as bigint) as a", "c_custkey as b"], "customer", "c_custkey % 5 = 0"),
    "spoken_owners": (["o_orderkey as path", "case when o_custkey % 10 = 0 then 'you' when o_orderkey % 3 = 0 then replace(c_name, 'Customer#', 'Cust ') else c_name end as owner", "'item ' || (o_orderkey % 50) as text", "c_mktsegment as grp"], _ORDERS, ""),
    "commitments": (["o_orderkey as path", "case when o_custkey % 10 = 0 then 'you' else c_name end as owner", "'item ' || (o_orderkey % 50) as text", "case when o_orderstatus = 'O' then 'open' else 'done' end as status", "c_mktsegment as grp", "cast(o_orderdate as date) as day"], _ORDERS, ""),
    "commitment_lines": (["o_orderkey as path", "case when o_custkey % 10 = 0 then 'you' else c_name end || ': ' || 'item ' || (o_orderkey % 50) || case when o_orderstatus = 'O' then '' else ' [done]' end as line"], _ORDERS, ""),
    "docs": (["d.doc_id as path", "left(split_part(text, chr(10), 1), 80) as title", "left(text, 160) as summary", "text as body", "source as grp", "source as vault", "d.doc_id % 3 + 1 as tier", "case d.doc_id % 10 when 0 then 'archived' when 1 then 'superseded' when 2 then 'complete' when 3 then 'complete' else 'active' end as status", "case when d.doc_id % 23 = 9 then 'memo' else case d.doc_id % 5 when 0 then 'decision' when 1 then 'digest' when 2 then 'explanation' when 3 then 'how-to' else 'reference' end end as doc_type", "case when d.doc_id % 31 = 5 then 'high' else case d.doc_id % 6 when 0 then 'inferred' when 1 then 'proposed' when 2 then 'stated' when 3 then 'unjudged' when 4 then 'unstated' else 'verified' end end as confidence", "case when d.doc_id % 17 = 0 then null when d.doc_id % 4 = 0 then 'conversation' when d.doc_id % 29 = 3 then 'decision' when d.doc_id % 4 = 1 then 'reference-frozen' when d.doc_id % 4 = 2 then 'reference-versioned' else 'unclassified' end as document_class", "lang as tag_lang", "case when quality is null then null else 'q' || quality end as tag_quality", "cast(quality as int) as quality"], "documents d left join labels l on d.doc_id = l.doc_id", ""),
    "segments": (["conv_id as call", "turn as seq", "case role when 'user' then 'you' when 'assistant' then 'them' else 'note' end as track", "turn * 15000 as start_ms", "text"], "conversations", ""),
    "threads": (["conv_id as id", "case conv_id % 5 when 0 then '' else 'w' || (conv_id % 5) end as workspace", "turn", "role", "text"], "conversations", ""),
    "page_paths": (["page_id", "url", "'v' || (page_id % 8) as vault", "case page_id % 4 when 0 then '00-operator' when 1 then '10-reference' when 2 then '02-areas' else '_sources/transcripts' end as folder", "'/root/' || 'v' || (page_id % 8) || '/' || case page_id % 4 when 0 then '00-operator' when 1 then '10-reference' when 2 then '02-areas' else '_sources/transcripts' end || '/' || page_id || '.md' as path"], "pages", ""),
    "meetings": (["event_id as meeting", "ts as start_ts", "ts + interval 30 minutes as end_ts", "user_id % 12 as calendar", "user_id", "case event_id % 4 when 0 then 'https://zoom.us/j/' || event_id when 1 then 'Room 4' when 2 then 'see Teams.Live.com/' || event_id end as location", "event_id % 11 = 0 as all_day"], "events", "event_type = 'signup'"),
    "recordings": (["event_id as recording", "ts as start_ts", "ts + interval 20 minutes as end_ts", "user_id as owner", "user_id % 12 as calendar"], "events", "event_type = 'purchase'"),
    "polls": (["event_id", "cast(floor(event_id / 50) as bigint) as poll", "user_id % 20 as scope", "case when event_id % 9 <> 0 then cast(ts as date) end as attempted"], "events", ""),
    "call_items": (["l_orderkey as path", "cast(l_linenumber as bigint) * 10000000000 + l_partkey * 10000 + l_suppkey as place", "case when l_suppkey % 3 = 0 then 'you' else 'Ann ' || (l_suppkey % 2) end as owner", "'item ' || (l_partkey % 2) as text", "case when l_linestatus = 'O' then 'open' else 'done' end as status"], "lineitem", ""),
    "passes": (["event_id", "user_id % 20 as scope", "ts as attempted", "case event_type when 'error' then 'compose_failed' when 'view' then 'unchanged' else 'refreshed' end as outcome"], "events", ""),
    "samples": (["event_id", "user_id % 40 as track", "case when user_id % 40 % 10 = 0 then value / 50000 else value / 500 end as x"], "events", ""),
    "screens": (["event_id", "user_id as call", "ts", "event_id * 40503 % 65536 as hash"], "events", ""),
    "replies": (["event_id", "user_id as key", "cast(floor(value) as int) % 7 as generation", "ts as arrival"], "events", ""),
    "snapshot_old": (["doc_id as path", "cast(doc_id as double) as mtime"], "documents", "doc_id % 7 <> 0"),
    "snapshot_new": (["doc_id as path", "cast(doc_id + case when doc_id % 13 = 0 then 5 else 0 end as double) as mtime"], "documents", "doc_id % 11 <> 0"),
    "terms": (["split_part(p_name, ' ', 1) as canonical", "min(split_part(p_name, ' ', 2)) as alias", "case min(p_partkey % 3) when 0 then '' when 1 then 'src1' else 'src2' end as grp"], "part", "true group by split_part(p_name, ' ', 1)"),
    "gold": (["item_id as id", "text as query", "left(text, 60) as needle"], "benchmark", ""),
}


def select(name: str) -> str:
    """The adapter as a SELECT statement."""
    columns, source, where = ADAPTERS[name]
    return f"select {', '.join(columns)} from {source}" + (f" where {where}" if where else "")


def with_tables(names: str, query: str, ctes: str = "") -> str:
    """A DuckDB query over adapters and further tables made from them, as common table expressions."""
    made = [f"{n} as ({select(n)})" for n in names.split()] + ([ctes] if ctes else [])
    return "with recursive " + ", ".join(made) + " " + query


class Tables:
    """Given tables and adapters of one folder, as DataFrames; ``t.calls``, ``t.orders``, ..."""

    GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.GIVEN:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in ADAPTERS:
            raise AttributeError(name)
        columns, source, where = ADAPTERS[name]
        return self._adapted(name, columns, where)

    def _adapted(self, name: str, columns: list[str], where: str) -> DataFrame:
        if name in ("calls", "commitments", "commitment_lines", "spoken_owners"):
            rows = self.orders.join(self.customer, _eq("o_custkey", "c_custkey"))
        elif name == "docs":
            # Titles and summaries are cut before the texts meet their labels, so that only those who read whole texts shuffle them.
            early = [c for c in columns if c.endswith((" as title", " as summary"))]
            rows = self.documents.selectExpr("*", *early).alias("d").join(self.labels.alias("l"), _eq("d.doc_id", "l.doc_id"), "left")
            columns = [c.rsplit(" as ", 1)[1] if c in early else c for c in columns]
        elif name == "terms":
            from pyspark.sql import functions as F

            word = F.split_part("p_name", F.lit(" "), F.lit(1))
            out = self.part.groupBy(word.alias("canonical")).agg(F.min(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("alias"), F.min(F.col("p_partkey") % 3).alias("k"))
            return out.selectExpr("canonical", "alias", "case k when 0 then '' when 1 then 'src1' else 'src2' end as grp")
        else:
            source = ADAPTERS[name][1]
            rows = getattr(self, source)
        return (rows.where(where) if where else rows).selectExpr(*columns)


def _eq(a: str, b: str):
    from pyspark.sql import functions as F

    return F.col(a) == F.col(b)
