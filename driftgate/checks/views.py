"""Stand-ins: generic tables read as declarations, statements and texts.

A supplier is a repository, a line item is "a pipeline loads a file", a part is "a file declares a table",
and dates before 1998 are the base revision. All tables are read whole.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.functions.text import ReferencePattern
from driftgate.model import BASE, HEAD, JOBS, OWNER_ROLE, PIPELINES, TOOLING_ROLE
from driftgate.operators.inventory import declared_names

DESTROY, INACTIVE = "allow-destroy", "allow-inactive"
TOOLING_REPO = "shared-ci"
HOST = r"^https?://(?:([a-z]+)\.)?([a-z]+)\.example\.([a-z]+)/"

# The owner in a page address: the host name, with the top-level domain as the repository.
URL_PATTERNS = tuple(
    ReferencePattern(
        f"{scheme} page", role, f"{scheme}://",
        before=rf"^{scheme}://(?:[a-z]+\.)?", org="[a-z]+", between=r"\.example\.", repo="[a-z]+", after="/",
    )
    for scheme, role in (("https", TOOLING_ROLE), ("http", OWNER_ROLE))
)
URL_OWNERS = tuple(
    ReferencePattern(
        f"{scheme} page", role, f"{scheme}://",
        before=rf"^{scheme}://(?:[a-z]+\.)?", org="[a-z]+", after=r"\.example\.",
    )
    for scheme, role in (("https", TOOLING_ROLE), ("http", OWNER_ROLE))
)


class Views:
    """Lazy views over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @staticmethod
    def revision(date: str) -> Column:
        change = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
        return F.when(F.col(date) < change, BASE).otherwise(HEAD)

    @cached_property
    def repos(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("repo"), "s_nationkey")

    # Declarations ------------------------------------------------------------------------------

    @cached_property
    def files(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("repo"),
            self.revision("l_shipdate").alias("rev"),
            F.col("l_partkey").alias("path"),
        )

    @cached_property
    def calls(self) -> DataFrame:
        variable = F.concat(F.lit("${var.catalog_"), F.lower("p_type"), F.lit("}"))
        return self.table("part").select(
            F.col("p_partkey").alias("path"),
            F.lit("dlt").alias("receiver"),
            F.lit("table").alias("method"),
            F.lit("keyword").alias("arg_source"),
            F.replace("p_name", F.lit(" "), F.lit("_")).alias("name_literal"),
            F.lit(False).alias("is_dynamic"),
            F.when(F.col("p_size") == 3, "${bundle.target}")
            .when(F.col("p_size") != 1, variable)
            .alias("catalog_ref"),
            F.when(
                F.col("p_size") != 2, F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
            ).alias("schema_ref"),
        )

    @cached_property
    def declared_rows(self) -> DataFrame:
        """Declared names with repeats."""
        return declared_names(self.files, self.calls, on=("path",))

    @cached_property
    def mixed_calls(self) -> DataFrame:
        """The calls, some of them with a name that is not a literal."""
        dynamic = F.col("path") % 7 == 0
        return self.calls.withColumns({
            "is_dynamic": dynamic, "name_literal": F.when(~dynamic, F.col("name_literal")),
        })

    @cached_property
    def providers(self) -> DataFrame:
        return self.repos.filter(F.col("s_nationkey") < 8).select("repo")

    @cached_property
    def given_files(self) -> DataFrame:
        """Files of pipelines whose catalog or schema key is absent, written as null, or written."""
        case = F.col("l_orderkey") % 4
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("repo"),
            self.revision("l_shipdate").alias("rev"),
            F.col("l_partkey").alias("path"),
            F.when(case == 0, "${var.main}").alias("catalog_ref"),
            (case <= 1).alias("catalog_given"),
            F.when(case == 2, " sales ").alias("schema_ref"),
            (case >= 2).alias("schema_given"),
        )

    @cached_property
    def named(self) -> DataFrame:
        return self.declared_rows.distinct()

    @cached_property
    def retired(self) -> DataFrame:
        return (
            self.declared_rows.filter(F.col("name").startswith("{catalog_economy}."))
            .select("repo", "name", F.lit("retired: old catalog").alias("reason"))
            .distinct()
        )

    @cached_property
    def inventories(self) -> DataFrame:
        """(repo, rev) with an inventory: the ones that name a cold table in one schema."""
        return self.declared_rows.filter(F.col("name").contains(".brand_7.cold")).select("repo", "rev")

    # Schemas -----------------------------------------------------------------------------------

    @cached_property
    def allowed(self) -> DataFrame:
        brands = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda n: F.concat(F.lit("brand_"), n))
        return self.repos.select("repo", "s_nationkey", F.explode(brands).alias("schema_name")).filter(
            (F.length("schema_name") + F.col("s_nationkey")) % 2 == 0
        ).select("repo", "schema_name")

    @cached_property
    def schema_config(self) -> DataFrame:
        """No lists, a literal list, an empty list, or a provided list, by nation."""
        brands = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda n: F.concat(F.lit("brand_"), n))
        case = F.col("s_nationkey") % 4
        every = F.concat(brands, F.array(F.lit("default"), F.lit("hr"), F.lit("sales")))
        odd = F.filter(brands, lambda b: F.length(b) % 2 == 1)
        return self.repos.select(
            "repo",
            F.when(case == 1, odd).when(case == 2, F.lit([]).cast("array<string>"))
            .when(case == 3, odd).alias("literal"),
            F.when(case == 3, every).alias("provided"),
        )

    # Resources ---------------------------------------------------------------------------------

    @cached_property
    def resource_files(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            self.revision("o_orderdate").alias("rev"),
            F.col("o_custkey").alias("key"),
            F.col("o_orderkey").alias("file_order"),
            F.col("o_orderpriority").alias("catalog"),
            status.alias("schema"),
            F.when(status != "P", status).alias("target"),
            F.month("o_orderdate").cast("string").alias("storage"),
            (F.col("o_totalprice") > 250000).cast("string").alias("serverless"),
        )

    @cached_property
    def resources(self) -> DataFrame:
        """The same definitions by repository and kind; a few repositories hold all of them."""
        return self.resource_files.withColumns({
            "repo": F.col("key") % 10,
            "kind": F.when(F.col("key") % 4 == 0, JOBS).otherwise(PIPELINES),
        })

    @cached_property
    def typed_resources(self) -> DataFrame:
        """Definitions whose settings are JSON texts: numbers, texts and objects in several spellings."""
        n = F.col("o_orderkey")
        pick = lambda by, *texts: F.get(F.array(*[F.lit(t) for t in texts]), (by % len(texts)).cast("int"))
        return self.table("orders").select(
            self.revision("o_orderdate").alias("rev"),
            F.col("o_custkey").alias("key"),
            n.alias("file_order"),
            pick(n, "1", "1.0", '"1"', "true", '{"a": [1, 2.0], "b": "x.0"}', '{"b": "x.0", "a": [1.0, 2]}').alias("catalog"),
            pick(n, "[1,2]", "[2, 1]", "null", None).alias("schema"),
            F.lit('"t"').alias("target"),
            pick(n, "1e2", "100", "100.50").alias("storage"),
            F.when(F.col("o_totalprice") > 250000, "true").otherwise('"true"').alias("serverless"),
        )

    # Revisions by year ---------------------------------------------------------------------------

    @staticmethod
    def year(date: str) -> Column:
        return F.concat(F.lit("y"), F.year(date))

    @cached_property
    def dated_files(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("repo"), self.year("l_shipdate").alias("rev"), F.col("l_partkey").alias("path")
        )

    @cached_property
    def dated_rows(self) -> DataFrame:
        return declared_names(self.dated_files, self.calls, on=("path",))

    @cached_property
    def dated_inventories(self) -> DataFrame:
        return self.dated_rows.filter(F.col("name").contains(".brand_7.")).select("repo", "rev")

    @cached_property
    def dated_resources(self) -> DataFrame:
        return self.resource_files.drop("rev").join(
            self.table("orders").select(F.col("o_orderkey").alias("file_order"), self.year("o_orderdate").alias("rev")), "file_order"
        ).withColumns({
            "repo": F.col("key") % 10,
            "kind": F.when(F.col("key") % 4 == 0, JOBS).otherwise(PIPELINES),
        })

    @cached_property
    def pairs(self) -> DataFrame:
        """Every repository has a base of its own, some a base that can't be read, and some a second pair."""
        nation = F.col("s_nationkey")
        first = F.struct(
            F.when(nation % 7 == 0, "lost").otherwise(F.concat(F.lit("y"), F.lit(1993) + nation % 4)).alias("base_rev"),
            F.lit("y1997").alias("head_rev"),
        )
        second = F.struct(F.lit("y1994").alias("base_rev"), F.lit("y1995").alias("head_rev"))
        return self.repos.select("repo", F.inline(F.array_compact(F.array(first, F.when(F.col("repo") % 3 == 0, second)))))

    # Paths ---------------------------------------------------------------------------------------

    @cached_property
    def relative_files(self) -> DataFrame:
        """Files as declarations write them: relative to a declaring file in one of three folders."""
        name = F.concat(F.lit("pipelines/"), F.col("l_partkey"), F.lit(".py"))
        place, case = F.col("l_linenumber") % 3, F.col("l_orderkey") % 5
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("repo"),
            self.revision("l_shipdate").alias("rev"),
            F.when(place == 0, "resources/p.yml").when(place == 1, "resources/more/p.yml").otherwise("p.yml").alias("declared_in"),
            F.when(case == 0, F.concat(F.lit("../"), name)).when(case == 1, F.concat(F.lit("./x/../../."), F.lit("/"), name))
            .when(case == 2, F.concat(F.lit("../..//"), name)).when(case == 3, name)
            .otherwise(F.concat(F.lit("/"), name)).alias("path"),
        )

    @cached_property
    def code_calls(self) -> DataFrame:
        """The calls with the path of their file from the top of the repository."""
        return self.calls.withColumn("path", F.concat(F.lit("pipelines/"), F.col("path"), F.lit(".py")))

    # Findings and labels -----------------------------------------------------------------------

    @cached_property
    def labels(self) -> DataFrame:
        case = F.col("s_nationkey") % 4
        return self.repos.select(
            "repo",
            F.when(case == 0, f"{DESTROY}, {INACTIVE}").when(case == 1, f" {INACTIVE} ,,")
            .when(case == 2, "other").otherwise("").alias("labels_csv"),
        )

    # Statements --------------------------------------------------------------------------------

    @cached_property
    def statements(self) -> DataFrame:
        brand = F.concat(F.lit("brand_"), F.col("user_id") % 5)
        kind = F.col("event_type")
        sql = (
            F.when(kind == "click", F.concat(F.lit("INSERT  INTO c."), brand, F.lit(".t SELECT 1")))
            .when(kind == "view", "SELECT * FROM c.hr.t")
            .when(
                kind == "signup",
                F.concat(F.lit("create table if not exists `"), brand, F.lit("`.t (a int)")),
            )
            .when(
                kind == "purchase",
                "MERGE INTO {c}.sales.t USING s ON 1=1; DROP TABLE IF EXISTS hr.t",
            )
            .otherwise("UPDATE t SET a = 1")
        )
        return self.table("events").select(
            "event_id", (F.col("user_id") % 7).alias("repo"), sql.alias("sql")
        )

    @cached_property
    def filed_statements(self) -> DataFrame:
        """The statements with the file they stand in."""
        return self.statements.withColumn("path", self.event_path)

    @cached_property
    def keyword_calls(self) -> DataFrame:
        """The calls, some of which pass their name by keyword."""
        return self.event_calls.withColumn(
            "arg_source", F.when(F.col("event_id") % 3 == 0, "keyword").otherwise(F.col("arg_source"))
        )

    @property
    def event_path(self) -> Column:
        return F.col("event_id") % 2000

    @cached_property
    def event_calls(self) -> DataFrame:
        """Events as calls found in code: three ways to declare a table, one to save, one to read."""
        kind = F.col("event_type")
        return self.table("events").select(
            "event_id",
            "user_id",
            (F.col("user_id") % 7).alias("repo"),
            F.when(kind == "purchase", "writer").when(kind == "error", "spark").otherwise("dlt")
            .alias("receiver"),
            F.when(kind == "click", "table").when(kind == "view", "view")
            .when(kind == "signup", "create_streaming_table").when(kind == "purchase", "saveAsTable")
            .otherwise("table").alias("method"),
            F.when(kind.isin("click", "view"), "keyword").otherwise("positional").alias("arg_source"),
            F.concat(F.lit("c.brand_"), F.col("user_id") % 25, F.lit(".t")).alias("name_literal"),
            (F.get_json_object("props", "$.k").cast("int") % 10 == 0).alias("is_dynamic"),
        )

    # References --------------------------------------------------------------------------------

    @cached_property
    def urls(self) -> DataFrame:
        return self.table("pages").select(
            "page_id", (F.col("page_id") % 10).alias("repo"), F.col("url").alias("text")
        )

    @cached_property
    def org_config(self) -> DataFrame:
        none = F.lit(None).cast("string")
        return self.repos.select(
            "repo",
            F.lit("tionsh").alias("owner_org"),
            none.alias("tooling_org"),
            F.lit("com").alias("tooling_repo"),
        )

    @cached_property
    def mixed_config(self) -> DataFrame:
        """Owners with and without a tooling owner, and repositories that declare nothing."""
        case = F.col("s_nationkey") % 5
        return self.repos.select(
            "repo",
            F.when(case != 0, "tionsh").alias("owner_org"),
            F.when(case.isin(1, 2), "thther").alias("tooling_org"),
            F.when(case == 2, "com").alias("tooling_repo"),
        )

    @cached_property
    def config_texts(self) -> DataFrame:
        """A settings text per page, with every kind of reference to the owner in its address."""
        org = F.regexp_extract("url", HOST, 2)
        owner = F.when(org != "", org).otherwise("nobody")
        repo = F.when(F.col("page_id") % 3 == 0, "other-ci").otherwise(TOOLING_REPO)
        text = F.concat(
            F.lit("jobs:\n\n  check:\n    uses: "), owner, F.lit("/"), repo,
            F.lit("/.github/workflows/ci.yml@v1\n  steps:\n    - uses: actions/checkout@v4\ndev = [\"x @ git+https://github.com/"),
            owner, F.lit("/"), repo, F.lit("@v1\"]\n* @"), owner, F.lit("/data @"), owner,
            F.lit("/ops\n\n  github_org = \""), owner, F.lit("\"\ntooling_org = \"thther\"\n# "),
            F.col("html"), F.lit("\n"),
        )
        return self.table("pages").select(
            "page_id", (F.col("page_id") % 10).alias("repo"), text.alias("text")
        )

    @cached_property
    def filed_texts(self) -> DataFrame:
        """The settings texts under paths that are governed and paths that are not."""
        case, number = F.col("page_id") % 6, F.col("page_id").cast("string")
        path = (
            F.when(case == 0, "pyproject.toml").when(case == 1, "docs/CODEOWNERS").when(case == 2, "docs/history.md")
            .when(case == 3, F.concat(F.lit(".github/workflows/"), number, F.lit(".yaml")))
            .when(case == 4, F.concat(F.lit(".github/workflows/old/"), number, F.lit(".yml")))
            .otherwise(F.concat(F.lit("src/"), number, F.lit(".py")))
        )
        return self.config_texts.withColumn("path", path)

    @cached_property
    def repo_texts(self) -> DataFrame:
        """The same files, six to a repository: one of each path."""
        return self.filed_texts.withColumn("repo", F.floor(F.col("page_id") / 6))
