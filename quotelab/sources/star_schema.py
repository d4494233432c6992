"""Order, customer, part and event tables of a star schema seen as the CRM tables.

Every value is a deterministic function of the given rows, so the same views can be written in
plain SQL for any other engine.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelab.session import configure
from quotelab.sources.tables import read_parquet, schema

AS_OF = "2001-01-01"
SIGNED_AT = "case when o_orderstatus = 'F' then created + make_dt_interval(cast(o_orderkey % 400 - 20 as int)) end"


def _conform(df: DataFrame, name: str) -> DataFrame:
    """Cast to the declared schema; absent columns are NULL."""
    have = set(df.columns)
    return df.selectExpr(
        *[
            f"cast({f.name if f.name in have else 'null'} as {f.dataType.simpleString()}) as {f.name}"
            for f in schema(name)
        ]
    )


def _order_lines(lineitem: DataFrame) -> DataFrame:
    """Per order: exact cents before and after discount."""
    cents = F.expr("cast(round(l_extendedprice * 100) as bigint)")
    kept = F.expr("100 - cast(round(l_discount * 100) as bigint)")
    return lineitem.groupBy("l_orderkey").agg(
        F.sum(cents).alias("gross_cents"), F.sum(cents * kept).alias("net_cents")
    )


class Lazy(Mapping):
    """Tables built when first asked for, so that a query opens only the files it reads."""

    def __init__(self, names: list[str], make: Callable[[str], DataFrame]):
        self._names, self._make, self._made = names, make, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def __iter__(self):
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def source_tables(spark: SparkSession, folder: str) -> Lazy:
    names = ["orders", "lineitem", "part", "customer", "nation", "events", "supplier", "pages", "documents"]
    return Lazy(names, lambda name: read_parquet(spark, f"{folder}/{name}.parquet"))


def crm_tables(spark: SparkSession, folder: str) -> Lazy:
    configure(spark)
    source = source_tables(spark, folder)

    def make(name: str) -> DataFrame:
        if name == "app_event_times":
            times = _conform(_event_times(source), "app_event")
            return times.select("client_id", "created_at", "signer_at")
        return _conform(_VIEWS[name](source), name)

    return Lazy([*_VIEWS, "app_event_times"], make)


def _orders(source: Mapping) -> DataFrame:
    """Orders with their creation time."""
    return source["orders"].selectExpr(
        "*", "o_orderdate + make_dt_interval(0, 0, 0, (o_custkey * 7919) % 86400) as created"
    )


def _priced_orders(source: Mapping) -> DataFrame:
    """Orders with the exact gross and net price of their lines."""
    lines = _order_lines(source["lineitem"])
    joined = _orders(source).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.selectExpr(
        "*",
        "cast((gross_cents div 200) / 100.0D as decimal(12,2)) as gross",
        "cast((net_cents div 20000) / 100.0D as decimal(12,2)) as net",
    )


def _events(source: Mapping) -> DataFrame:
    return _priced_orders(source).selectExpr(
        "o_orderkey as id",
        "concat('D', lpad(cast(o_orderkey as string), 9, '0')) as num_devis",
        "created as created_at",
        "o_custkey as client_id",
        "o_orderkey as event_details_id",
        "case when o_orderkey % 20 <> 7 then o_orderkey end as event_product_id",
        "case when o_orderkey % 10 <> 3 then o_orderkey end as event_option_id",
        "case when o_orderstatus = 'F' then o_orderkey end as event_acompte_id",
        "case when o_orderstatus = 'F' and o_orderkey % 3 = 0 then o_orderkey end as event_post_presta_id",
        "case when o_orderstatus = 'F' then 'Presta FINI' when o_orderstatus = 'O' then 'Refused' "
        "when o_orderkey % 3 = 0 then 'Sended' when o_orderkey % 3 = 1 then 'Last Chance' end as status",
        "concat_ws('>', 'Initied', o_orderstatus) as history_status",
        f"{SIGNED_AT} as signer_at",
        "gross as prix_brut",
        "net as prix_proposed",
        "case when o_orderstatus = 'F' and o_orderkey % 4 <> 0 then net "
        "when o_orderstatus = 'P' and net_cents * 20 <= gross_cents * 1900 then net end as prix_valided",
        "case when o_orderkey % 2 = 0 then gross - net end as reduc_product",
        "case when o_orderkey % 2 = 1 then gross - net end as reduc_all",
    )


def _event_times(source: Mapping) -> DataFrame:
    """Client and times of every event, without the prices, which take a join with the order lines."""
    return _orders(source).selectExpr(
        "o_custkey as client_id",
        "created as created_at",
        f"{SIGNED_AT} as signer_at",
    )


def _clients(source: Mapping) -> DataFrame:
    return source["customer"].selectExpr(
        "c_custkey as id",
        "case when c_custkey % 50 = 0 then null when c_custkey % 50 = 1 then '  ' else c_mktsegment end "
        "as how_find",
        "case c_custkey % 5 when 0 then 1 when 1 then null else 0 end as raison_sociale",
    )


def _details(source: Mapping) -> DataFrame:
    places = (
        source["customer"]
        .join(source["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .selectExpr("c_custkey", "c_nationkey", "c_mktsegment", "n_name")
    )
    placed = _orders(source).join(places, F.col("o_custkey") == F.col("c_custkey"), "left")
    return placed.selectExpr(
        "o_orderkey as id",
        "date_add(cast(created as date), cast(o_orderkey * 31 % 480 - 10 as int)) as date_evenement",
        "lpad(cast(1000 + c_nationkey * 37 as string), 5, '0') as code_postal_evenement",
        "case when o_orderkey % 25 = 0 then null else concat(' Cité ', n_name, ' ') end as ville_evenement",
        "case when o_orderkey % 9 = 0 then null when o_orderkey % 9 = 1 then '   ' "
        "else concat('Château ', cast(o_custkey div 3 as string), ' rue ', lower(n_name)) end "
        "as adresse_evenement",
        "case o_orderkey % 4 when 0 then null when 1 then ' ' else '18h-23h' end as horaire",
        "case when o_orderkey % 3 = 0 then null else concat(o_orderpriority, ' ', c_mktsegment) end "
        "as comment_client",
        "case when o_orderkey % 6 = 0 then 'vérifié' end as comment",
    )


def _products(source: Mapping) -> DataFrame:
    """Machines asked for, from the part types of the order lines."""
    kinds = {"photobooth": "STANDARD", "miroirbooth": "ECONOMY", "videobooth": "MEDIUM", "voguebooth": "PROMO"}
    parts = source["part"].select("p_partkey", "p_type")
    typed = source["lineitem"].join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    most = {"photobooth": 2}
    return (
        typed.groupBy(F.col("l_orderkey").alias("id"))
        .agg(*[F.count_if(F.col("p_type") == kind).alias(name) for name, kind in kinds.items()])
        .withColumns({name: F.least(F.col(name), F.lit(most.get(name, 1))) for name in kinds})
        .withColumn("ipadbooth", F.when(F.col("id") % 50 == 0, 1).otherwise(0))
    )


def _options(source: Mapping) -> DataFrame:
    return _orders(source).selectExpr(
        "o_orderkey as id",
        "case when o_orderkey % 6 = 0 then 1 else 0 end as MurFloral",
        "case when o_orderkey % 12 = 0 then 'boheme' end as mur_floral_style",
        "case when o_orderkey % 5 < 2 then 1 else 0 end as Phonebooth",
        "case when o_orderkey % 7 = 0 then 1 end as Fond360",
        "case when o_orderkey % 15 = 0 then 1 else 0 end as PanneauFontaine",
        "case when o_orderkey % 11 < 3 then 1 end as VideoLivreOr",
        "o_orderkey % 8 * 40 as magnets",
        "case when o_orderkey % 16 = 0 then 150 end as PorteCles",
        "case when o_orderkey % 40 = 1 then 1 else 0 end as livraison",
        "case o_orderkey % 30 when 0 then 6 when 1 then null else 5 end as duree",
        "case when o_orderkey % 14 = 0 then 10 end as Phonebooth_reduc_prix",
        "case when o_orderkey % 21 = 0 then 25.5 end as VideoLivreOr_reduc_prix",
    )


def _deposits(source: Mapping) -> DataFrame:
    return _priced_orders(source).where("o_orderstatus = 'F'").selectExpr(
        "o_orderkey as id",
        "cast(round(gross * 30) / 100.0D as decimal(12,2)) as montant_acompte",
        "o_orderpriority as mode_payement",
        "cast(created + make_dt_interval(cast(o_orderkey % 400 - 20 as int)) as date) as date_payement",
        "gross as montant_restant",
    )


def _services(source: Mapping) -> DataFrame:
    return _orders(source).where("o_orderstatus = 'F' and o_orderkey % 3 = 0").selectExpr(
        "o_orderkey as id",
        "o_orderkey % 200 as charge",
        "case when o_orderkey % 2 = 0 then o_orderkey % 90 end as membre_salary",
        "cast(o_orderkey % 2 as int) as client_paid",
        "cast(o_orderkey % 5 as int) as members_paid",
    )


def _emails(source: Mapping) -> DataFrame:
    return source["events"].selectExpr(
        "case when event_id % 31 <> 0 then event_id div 3 end as event_traced",
        "case when event_type in ('click', 'view') then 1 else 0 end as opened",
        "ts as sent_at",
        "case when event_type in ('click', 'view') then ts + make_dt_interval(0, 0, 0, event_id % 5000) end "
        "as opened_at",
    )


def _calls(source: Mapping) -> DataFrame:
    return source["events"].where("event_type in ('error', 'signup')").selectExpr(
        "event_id div 5 as event_id",
        "ts as date_relance",
        "case when event_id % 13 <> 0 then cast(floor(value) as bigint) % 6 end as qualification",
        "case event_id % 3 when 0 then null when 1 then '  ' else event_type end as commentaire",
    )


def _costs(source: Mapping) -> DataFrame:
    return source["supplier"].selectExpr(
        "s_suppkey as id",
        "s_nationkey as name_cost_id",
        "case when s_suppkey % 2 = 0 then 'FIXE' else 'VARIABLE' end as type_cost",
        "s_acctbal as price_cost",
        "timestamp'2001-01-01 00:00:00' + make_dt_interval(cast(s_suppkey % 365 as int)) as created_at",
        "case when s_suppkey % 3 = 0 then 'ANNUEL' else 'MENSUEL' end as frecency",
    )


def _names(source: Mapping) -> DataFrame:
    return source["nation"].selectExpr("n_nationkey as id", "n_name as name")


_VIEWS = {
    "app_event": _events,
    "app_client": _clients,
    "app_eventdetails": _details,
    "app_eventproduct": _products,
    "app_eventoption": _options,
    "app_eventacompte": _deposits,
    "app_eventpostprestation": _services,
    "app_emailtracking": _emails,
    "app_eventrelance": _calls,
    "app_cost": _costs,
    "app_namecost": _names,
}


def lookup_places(source: Mapping, queries: DataFrame) -> DataFrame:
    """Candidate places per lookup: the first five suppliers of the nation named in the query.

    Lookups whose hash starts with 0 stand for failed ones.
    """
    by_nation = W.partitionBy("s_nationkey").orderBy("s_suppkey")
    five = (
        source["supplier"]
        # A rank limit is applied before the shuffle too, so a large nation sends five rows per task.
        .withColumn("rank", F.row_number().over(by_nation))
        .where("rank <= 5")
        .selectExpr(
            "s_nationkey",
            "rank - 1 as pos",
            "concat(element_at(array('Château ', 'Domaine ', 'Salle '), cast(s_suppkey % 3 as int) + 1), s_suppkey)"
            " as display_name",
            "concat(s_suppkey % 7, ' rue Nation-', s_nationkey, ', ', lpad(1000 + s_nationkey * 37, 5, '0'))"
            " as formatted_address",
            "element_at(array('event_venue', 'premise', 'hotel'), cast(s_suppkey % 3 as int) + 1) as primary_type",
            "case s_suppkey % 4 when 0 then array('event_venue', 'street_address') when 1 then array('premise') "
            "when 2 then cast(null as array<string>) else array('hotel') end as types",
            "case when s_suppkey % 9 <> 0 then 2.5D + (s_suppkey % 11) / 4D end as rating",
            "case when s_suppkey % 8 <> 0 then cast(s_suppkey * 37 % 5000 as int) end as user_rating_count",
            "case when s_suppkey % 3 <> 0 then concat('https://venue', s_suppkey, '.example.com') end as website_uri",
            "element_at(array('PRICE_LEVEL_FREE', 'PRICE_LEVEL_INEXPENSIVE', 'PRICE_LEVEL_MODERATE', "
            "'PRICE_LEVEL_EXPENSIVE', 'PRICE_LEVEL_VERY_EXPENSIVE', null), cast(s_suppkey % 6 as int) + 1)"
            " as price_level",
        )
    )
    named = queries.withColumn(
        "_nation", F.regexp_extract("query_norm", "nation ([0-9]+)", 1).try_cast("int")
    )
    failed = F.when(F.col("query_hash").startswith("0"), "HTTP_ERROR_TimeoutError")
    return (
        named.select("query_hash", "_nation")
        .distinct()
        .join(five, F.col("_nation") == F.col("s_nationkey"))
        .withColumn("status", failed)
        .drop("_nation", "s_nationkey")
    )


def venue_overrides(quotes: DataFrame) -> DataFrame:
    """Verified venues for some keys: those of every 60th client's quotes with an address."""
    keys = quotes.where("request_event_id % 450 = 2").select("event_venue_anonymous_key").distinct()
    return keys.selectExpr(
        "event_venue_anonymous_key as match_key",
        "concat('Domaine ', substring(event_venue_anonymous_key, 1, 4)) as venue_name",
        "'event_venue' as venue_type",
        "'180' as venue_capacity_seated",
        "' ' as venue_capacity_cocktail",
        "'5000' as venue_price_min",
        "'9000.5' as venue_price_max",
        "'75' as venue_premium_score",
        "'80' as venue_notability_score",
        "case when substring(event_venue_anonymous_key, 1, 1) < '8' then 'https://example.com' else '' end"
        " as source_url",
    )
