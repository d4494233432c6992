"""CRM tables: declared schemas and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTION_SOURCES = [
    "MurFloral", "Phonebooth", "LivreOr", "Fond360", "PanneauBienvenue", "PhotographeVoguebooth",
    "ImpressionVoguebooth", "DecorVoguebooth", "Holo3D", "PanneauFontaine", "VideoLivreOr",
]
QUANTITY_SOURCES = ["magnets", "PorteCles", "MagnetsSimple"]

_MONEY = "decimal(12,2)"
SCHEMAS = {
    "app_event": (
        "id long, num_devis string, created_at timestamp, client_id long, event_details_id long, "
        "event_product_id long, event_option_id long, event_acompte_id long, "
        "event_post_presta_id long, status string, history_status string, signer_at timestamp, "
        f"prix_brut {_MONEY}, prix_proposed {_MONEY}, prix_valided {_MONEY}, "
        f"reduc_product {_MONEY}, reduc_all {_MONEY}"
    ),
    "app_client": "id long, how_find string, raison_sociale int",
    "app_eventdetails": (
        "id long, date_evenement date, code_postal_evenement string, ville_evenement string, "
        "adresse_evenement string, horaire string, comment_client string, comment string"
    ),
    "app_eventproduct": (
        "id long, photobooth int, miroirbooth int, videobooth int, voguebooth int, ipadbooth int, "
        "airbooth int"
    ),
    "app_eventoption": (
        "id long, "
        + ", ".join(f"{c} int" for c in OPTION_SOURCES)
        + ", mur_floral_style string, "
        + ", ".join(f"{c} int" for c in QUANTITY_SOURCES)
        + ", livraison int, duree int, "
        + ", ".join(f"{c}_reduc_prix {_MONEY}" for c in [*OPTION_SOURCES, *QUANTITY_SOURCES])
    ),
    "app_eventacompte": (
        f"id long, montant_acompte {_MONEY}, mode_payement string, date_payement date, "
        f"montant_restant {_MONEY}"
    ),
    "app_eventpostprestation": (
        f"id long, charge {_MONEY}, membre_salary {_MONEY}, client_paid int, members_paid int"
    ),
    "app_emailtracking": "event_traced long, opened int, sent_at timestamp, opened_at timestamp",
    "app_eventrelance": (
        "event_id long, date_relance timestamp, qualification int, commentaire string"
    ),
    "app_cost": (
        f"id long, name_cost_id long, type_cost string, price_cost {_MONEY}, created_at timestamp, "
        "frecency string"
    ),
    "app_namecost": "id long, name string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def with_instants(df: DataFrame) -> DataFrame:
    """Zone-less timestamps become UTC instants (the session time zone is UTC)."""
    naive = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return with_instants(spark.read.parquet(path))


def read_crm(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """One parquet table per CRM table under ``folder``; scans are lazy and column-pruned."""
    return {name: read_parquet(spark, f"{folder}/{name}.parquet") for name in SCHEMAS}


def read_crm_jdbc(
    spark: SparkSession, url: str, lower: int, upper: int, partitions: int, **options: str
) -> dict[str, DataFrame]:
    """The same tables from the CRM database, read in parallel ranges of their integer key."""
    tables = {}
    for name in SCHEMAS:
        key = schema(name).fieldNames()[0]
        tables[name] = with_instants(
            spark.read.format("jdbc")
            .options(url=url, dbtable=name, **options)
            .option("partitionColumn", key)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", partitions)
            .option("preferTimestampNTZ", "false")
            .load()
        )
    return tables
