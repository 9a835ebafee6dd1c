"""The logical tables of a code tree, projected from the driver's tables, in DataFrame form and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


#: name beginnings of ``named_files``, in turn
NAMES = ("customer_", "config_", "auth_", "mongodb_", "mail_", "admin_", "api/", "cron_", "app/api/c", "pages/", "lib/", "src/core/")


class Views:
    """Lazy projections; nothing is read before a query asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def repositories(self) -> DataFrame:
        return self.t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))

    def files(self) -> DataFrame:
        path = F.concat(F.lit("mod"), F.col("c_nationkey").cast("string"), F.lit("/"), F.replace(F.lower("c_name"), F.lit("#"), F.lit("_")), F.lit(".py"))
        return self.t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("repository_id"), path.alias("path"), F.lower("c_mktsegment").alias("language"), F.floor(F.abs("c_acctbal")).cast("long").alias("loc"))

    def named_files(self) -> DataFrame:
        """Files whose names take turns among those that mean something to the operators."""
        k = (F.col("c_custkey") % len(NAMES) + 1).cast("int")
        path = F.concat(F.lit("mod"), F.col("c_nationkey").cast("string"), F.lit("/"), F.element_at(F.array(*map(F.lit, NAMES)), k), F.col("c_custkey").cast("string"), F.when(k == 9, "/route.ts").otherwise(".py"))
        hours = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(c_custkey AS int), 0, 0)")
        return self.t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("repository_id"), path.alias("path"), F.lower("c_mktsegment").alias("language"), F.floor(F.abs("c_acctbal")).cast("long").alias("loc"), hours.alias("last_modified"))

    def ring_edges(self) -> DataFrame:
        """Customers of a nation in rings of those whose keys have the same number of two hundreds."""
        group = Window.partitionBy("c_nationkey", F.floor(F.col("c_custkey") / 200))
        order = group.orderBy("c_custkey")
        return self.t("customer").select(F.col("c_custkey").alias("src"), F.coalesce(F.lead("c_custkey").over(order), F.min("c_custkey").over(group)).alias("dst"))

    def typed_edges(self) -> DataFrame:
        return self.edges().select("src", "dst", F.when((F.col("src") + F.col("dst")) % 3 == 0, "references").otherwise("imports").alias("edge_type"))

    def link_paths(self) -> DataFrame:
        """Paths with brackets, with one directory and at the root, for mentions."""
        k = F.col("p_partkey").cast("string")
        kinds = F.array(F.concat(F.lit("app/[slug]/page_"), k, F.lit(".tsx")), F.concat(F.lit("lib/util_"), k, F.lit(".ts")), F.concat(F.lit("NOTES-"), k, F.lit(".md")))
        return self.t("part").select(F.explode(kinds).alias("path"))

    def bodies(self) -> DataFrame:
        """Texts that mention such paths in full, inside other words, or by a name in backticks."""
        k = F.format_string("%d", F.col("doc_id") % 180)
        said = F.array(F.concat(F.lit(" see xapp/[slug]/page_"), k, F.lit(".tsx,")), F.concat(F.lit(" `util_"), k, F.lit(".ts` and ` x")), F.concat(F.lit(" readmeNOTES-"), k, F.lit(".mdx")), F.concat(F.lit(" util_"), k, F.lit(".ts")))
        return self.t("documents").select(F.col("doc_id").alias("id"), F.concat(F.coalesce("text", F.lit("")), F.element_at(said, (F.col("doc_id") % 4 + 1).cast("int"))).alias("body"))

    def parts(self) -> DataFrame:
        path = F.concat(F.lit("src/"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))), F.lit("/"), F.lower("p_type"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".py"))
        return self.t("part").select(F.col("p_partkey").alias("id"), path.alias("path"), F.lower("p_type").alias("language"), F.floor("p_retailprice").cast("long").alias("loc"))

    def symbols(self) -> DataFrame:
        return self.t("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_id"), F.concat(F.lit("fn_"), F.col("o_orderkey").cast("string"), F.lower("o_orderstatus")).alias("name"), F.lower(F.substring_index("o_orderpriority", "-", -1)).alias("kind"), (F.col("o_orderkey") % 997 + 1).cast("long").alias("line_start")
        )

    def edges(self) -> DataFrame:
        order = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
        steps = self.t("events").select(F.col("user_id").alias("src"), F.lead("user_id").over(order).alias("dst"))
        return steps.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))

    def commits(self) -> DataFrame:
        return self.t("events").select(F.col("event_id").alias("id"), F.lpad(F.hex("event_id"), 12, "0").alias("hash"), F.col("ts").alias("date"), F.col("user_id").alias("author"), F.col("event_type").alias("message"))

    def links(self) -> DataFrame:
        return self.t("lineitem").select(F.col("l_partkey").alias("file_id"), F.col("l_orderkey").alias("commit_id"))

    def documents(self) -> DataFrame:
        return self.t("documents").select("doc_id", F.concat(F.col("source"), F.lit("/"), F.when(F.col("lang") == "de", "README_").when(F.col("lang") == "fr", "overview_").otherwise("notes_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("source").alias("repository"), F.col("text").alias("content"))

    def messages(self) -> DataFrame:
        return self.t("conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))


#: the same projections for the SQL side
SQL = """WITH repositories AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation),
files AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS repository_id, 'mod' || CAST(c_nationkey AS VARCHAR) || '/' || replace(lower(c_name), '#', '_') || '.py' AS path, lower(c_mktsegment) AS language, CAST(floor(abs(c_acctbal)) AS BIGINT) AS loc FROM customer),
parts AS (SELECT p_partkey AS id, 'src/' || lower(replace(p_brand, '#', '_')) || '/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || '.py' AS path, lower(p_type) AS language, CAST(floor(p_retailprice) AS BIGINT) AS loc FROM part),
symbols AS (SELECT o_orderkey AS id, o_custkey AS file_id, 'fn_' || CAST(o_orderkey AS VARCHAR) || lower(o_orderstatus) AS name, lower(split_part(o_orderpriority, '-', -1)) AS kind, CAST(o_orderkey % 997 + 1 AS BIGINT) AS line_start FROM orders),
edges AS (SELECT src, dst, count(*) AS n FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst FROM events) s WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst),
commits AS (SELECT event_id AS id, lpad(upper(to_hex(event_id)), 12, '0') AS hash, ts AS date, user_id AS author, event_type AS message FROM events),
links AS (SELECT l_partkey AS file_id, l_orderkey AS commit_id FROM lineitem),
docs AS (SELECT doc_id, source || '/' || CASE WHEN lang = 'de' THEN 'README_' WHEN lang = 'fr' THEN 'overview_' ELSE 'notes_' END || CAST(doc_id AS VARCHAR) || '.md' AS path, source AS repository, text AS content FROM documents),
named AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS repository_id, 'mod' || CAST(c_nationkey AS VARCHAR) || '/' || ['customer_', 'config_', 'auth_', 'mongodb_', 'mail_', 'admin_', 'api/', 'cron_', 'app/api/c', 'pages/', 'lib/', 'src/core/'][c_custkey % 12 + 1] || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 12 = 8 THEN '/route.ts' ELSE '.py' END AS path, lower(c_mktsegment) AS language, CAST(floor(abs(c_acctbal)) AS BIGINT) AS loc, TIMESTAMP '2024-01-01' + to_hours(c_custkey) AS last_modified FROM customer),
link_paths AS (SELECT unnest(['app/[slug]/page_' || p_partkey || '.tsx', 'lib/util_' || p_partkey || '.ts', 'NOTES-' || p_partkey || '.md']) AS path FROM part),
bodies AS (SELECT doc_id AS id, coalesce(text, '') || [' see xapp/[slug]/page_' || (doc_id % 180) || '.tsx,', ' `util_' || (doc_id % 180) || '.ts` and ` x', ' readmeNOTES-' || (doc_id % 180) || '.mdx', ' util_' || (doc_id % 180) || '.ts'][doc_id % 4 + 1] AS body FROM documents),
messages AS (SELECT conv_id AS session_id, turn AS id, role, text AS content FROM conversations)"""
