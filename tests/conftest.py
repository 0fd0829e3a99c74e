import datetime
import decimal

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


SCHEMAS = {
    "machines": "id long, website_id long, machine_type string, brand string, model string, stock_number string, price decimal(14,2), currency string, location string, description string, machine_url string, website_source string, brand_normalized string, model_normalized string, type_normalized string, content_hash string, dedup_key string, thumbnail_url string, thumbnail_local string, search_vector string, is_active boolean, created_at timestamp_ntz, updated_at timestamp_ntz, last_crawled_at timestamp_ntz, machine_name string, condition string, year int",
    "machine_specs": "id long, machine_id long, spec_key string, spec_value string, spec_unit string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, doc_kind string, published_at timestamp_ntz",
    "brand_ref": "brand_id long, brand_name string, aliases string, country string",
    "type_ref": "type_id long, type_name string, synonyms string",
    "spec_attributes": "attr_name string, data_type string, quantity string, base_unit string, labels string",
    "unit_ref": "unit_name string, quantity string, base_unit string, factor double, offset_value double",
    "exchange_rates": "currency_code string, eur_per_unit double",
    "mix_targets": "source_name string, target_share double, max_repeats int",
    "container_sizes": "container_name string, capacity_tokens int",
}
REFERENCE = {
    "brand_ref": [(1, "Norvikson", "NVK;Norvikson Werke", "NO"), (2, "Haller & Sons", None, "GB"), (3, "Müllerbach", None, "DE")],
    "type_ref": [(1, "Panel Saw", "beam saw;Plattensäge"), (2, "Turret Punch", "revolver punch;Revolverstanze")],
    "spec_attributes": [("weight", "decimal", "mass", "kg", "Weight;Gewicht"), ("axis_count", "int", None, None, "Number of axes"), ("ce_marked", "boolean", None, None, "CE mark"), ("control_unit", "text", None, None, "Control;Steuerung")],
    "unit_ref": [("kg", "mass", "kg", 1.0, 0.0), ("t", "mass", "kg", 1000.0, 0.0), ("lb", "mass", "kg", 0.453592, 0.0)],
    "exchange_rates": [("EUR", 1.0), ("GBP", 1.2)],
    "mix_targets": [("a", 0.6, 2), ("b", 0.3, 1), ("gone", 0.1, 3)],
    "container_sizes": [("tiny", 16), ("small", 64)],
}


class Data:
    """Writes small tables into a folder laid out like the driver's."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def put(self, name, rows, extra=""):
        schema = SCHEMAS[name]
        names = [f.split()[0] for f in schema.split(", ")]
        filled = [tuple(r.get(n) for n in names) if isinstance(r, dict) else tuple(r) for r in rows]
        if extra:
            schema += ", " + extra
            filled = [r + ("x",) * (extra.count(",") + 1) for r in filled]
        self.spark.createDataFrame(filled, schema).coalesce(2).write.mode("overwrite").parquet(f"{self.folder}/{name}.parquet")
        return self

    def rest(self, extra=""):
        import os

        for name in SCHEMAS:
            if not os.path.exists(f"{self.folder}/{name}.parquet"):
                self.put(name, REFERENCE.get(name, []), extra)
        return str(self.folder)


@pytest.fixture
def data(spark, tmp_path):
    return Data(spark, tmp_path)


def at(day):
    return datetime.datetime(2025, 1, 1) + datetime.timedelta(days=day)


def money(x):
    return decimal.Decimal(str(x))
