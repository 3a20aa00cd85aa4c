"""The logical tables, and the two joins that most metrics share."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import join_keys, partition_column, partition_columns
from .schemas import SCHEMAS, conformed


def renamed(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Select ``columns`` (source name: new name), and the partition columns of the timestamps among them.

    A partition column of the order's creation stays as well.
    """
    picked = {}
    for source, target in columns.items():
        picked[target] = F.col(source).alias(target)
        for grain, name in partition_columns(df, source).items():
            picked[partition_column(target, grain)] = F.col(name).alias(partition_column(target, grain))
    for name in partition_columns(df, "order_created").values():
        picked[name] = F.col(name)
    return df.select(*picked.values())


# The joins that most metrics share, and the tables that each is made of.
JOINS = {
    "line_facts": {"ord_order", "ord_order_line"},
    "release_facts": {"ord_release", "ord_release_line", "inv_location", "org_location"},
}
JOINS["spine"] = JOINS["line_facts"] | JOINS["release_facts"] | JOINS.keys()


def by_update(name: str) -> str:
    """Under what name a table is known that is laid out by its last update (see ``sources.layout``)."""
    return f"{name}__by_update"


class Tables:
    """Logical tables by name, loaded and conformed on first use. ``load`` raises KeyError(name) for a name it does not know.

    ``line_facts``, ``release_facts`` and ``spine`` are the joins that most metrics start from. They are plain lazy
    plans unless the loader knows them as stored tables (see ``plans.shared``). In the spine a release line belongs to
    a line of its release's order.
    """

    def __init__(self, load: Callable[[str], DataFrame]):
        self._load = load
        self._frames: dict[str, DataFrame] = {}
        # kept apart, so that tables made from these do not inherit joins of other rows
        self._plans: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            frame = self._load(name)
            self._frames[name] = conformed(name, frame) if name in SCHEMAS else frame
        return self._frames[name]

    def replaced(self, frames: Mapping[str, DataFrame]) -> Tables:
        """The same tables, with ``frames`` in place of those of the same name.

        Stored joins that one of these tables is part of are made anew.
        """
        stale = {name for name, parts in JOINS.items() if parts & frames.keys() and name not in frames}
        stale |= {by_update(name) for name in frames}

        def load(name: str) -> DataFrame:
            if name in frames:
                return frames[name]
            if name in stale:
                raise KeyError(name)
            return self[name]

        return Tables(load)

    def _derived(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stored table ``name``, else the plan that ``build`` makes from these very tables."""
        if name not in self._plans:
            try:
                self._plans[name] = self[name]
            except KeyError as unknown:
                if unknown.args != (name,):
                    raise  # an error inside the loader
                self._plans[name] = build()
        return self._plans[name]

    def _updated(self, name: str) -> DataFrame | None:
        """The table as it is laid out by its last update, if it is."""
        try:
            frame = self[by_update(name)]
        except KeyError as unknown:
            if unknown.args != (by_update(name),):
                raise
            return None
        return conformed(name, frame)

    @property
    def release_facts(self) -> DataFrame:
        """One row per release line, with its release and the sub-types of the location it ships from.

        The location columns are NULL where a schema does not know the location; ``at_inv_location`` tells that from
        a known location without sub-type.
        """
        return self._derived("release_facts", self._release_facts)

    def _release_facts(self) -> DataFrame:
        lines = renamed(
            self["ord_release_line"],
            {
                "release_pk": "release_pk",
                "order_line_id": "order_line_id",
                "release_line_id": "release_line_id",
                "item_id": "release_item_id",
                "quantity": "released_quantity",
                "fulfilled_quantity": "fulfilled_quantity",
                "cancelled_quantity": "cancelled_quantity",
                "created_timestamp": "release_line_created",
            },
        )
        releases = renamed(
            self["ord_release"],
            {
                "pk": "release_pk",
                "order_pk": "order_pk",
                "order_id": "order_id",
                "release_id": "release_id",
                "ship_from_location_id": "ship_from_location_id",
                "destination_action": "destination_action",
                "delivery_method_id": "release_delivery_method_id",
                "created_timestamp": "release_created",
            },
        )
        inventory = self["inv_location"].select(
            F.col("location_id").alias("ship_from_location_id"),
            F.col("location_sub_type_id").alias("sub_type"),
            F.lit(True).alias("at_inv_location"),
        )
        organization = self["org_location"].select(
            F.col("location_id").alias("ship_from_location_id"),
            F.col("location_sub_type_id").alias("org_sub_type"),
        )
        # no broadcast hints: Spark broadcasts a location table by its known size and shuffles a larger one
        placed = releases.join(inventory, "ship_from_location_id", "left").join(
            organization, "ship_from_location_id", "left"
        )
        return lines.join(placed, join_keys(lines, placed, "release_pk"))

    @property
    def line_facts(self) -> DataFrame:
        """One row per order line, with the columns of its order that the metrics read."""
        return self._derived("line_facts", lambda: self._line_facts(self["ord_order_line"]))

    @property
    def line_updates(self) -> DataFrame | None:
        """``line_facts`` for windows on the lines' last update, if the lines are laid out by its day; else None."""
        lines = self._updated("ord_order_line")
        return None if lines is None else self._derived("line_updates", lambda: self._line_facts(lines))

    @property
    def order_updates(self) -> DataFrame:
        """``orders`` for windows on their last update."""
        found = self._updated("ord_order")
        return self.orders if found is None else self._orders(found)

    def _line_facts(self, order_lines: DataFrame) -> DataFrame:
        lines = renamed(
            order_lines,
            {
                "pk": "line_pk",
                "order_pk": "order_pk",
                "order_line_id": "order_line_id",
                "org_id": "line_org_id",
                "item_id": "item_id",
                "quantity": "line_quantity",
                "line_type_id": "line_type_id",
                "order_line_sub_total": "order_line_sub_total",
                "cancelled_order_line_sub_total": "cancelled_order_line_sub_total",
                "created_timestamp": "line_created",
                "updated_timestamp": "line_updated",
                "is_on_hold": "line_is_on_hold",
                "is_cancelled": "line_is_cancelled",
                "max_fulfillment_status_id": "line_max_status",
                "min_fulfillment_status_id": "line_min_status",
                "delivery_method_id": "delivery_method_id",
                "is_return": "is_return",
                "is_even_exchange": "is_even_exchange",
                "ext_promise_release_s_l_a": "promised_release",
                "promised_ship_date": "promised_ship",
                "promised_delivery_date": "promised_delivery",
            },
        )
        orders = self.orders
        return lines.join(orders, join_keys(lines, orders, "order_pk"))

    @property
    def orders(self) -> DataFrame:
        """One row per order, with the columns that the metrics read."""
        return self._orders(self["ord_order"])

    def _orders(self, rows: DataFrame) -> DataFrame:
        return renamed(
            rows,
            {
                "pk": "order_pk",
                "order_id": "order_id",
                "org_id": "org_id",
                "created_timestamp": "order_created",
                "updated_timestamp": "order_updated",
                "captured_date": "captured_date",
                "is_confirmed": "is_confirmed",
                "max_fulfillment_status_id": "order_max_status",
                "max_return_status_id": "max_return_status_id",
                "return_line_count": "return_line_count",
                "selling_channel_id": "selling_channel_id",
            },
        )

    @property
    def spine(self) -> DataFrame:
        """One row per release line, with its release, location, order line and order.

        Order and line columns are NULL for a release line without order line; a filter on one of them makes the join
        an inner one.
        """
        return self._derived("spine", lambda: join_spine(self.release_facts, self.line_facts))


# Columns of ``line_facts`` that no metric reads together with releases; a stored spine does without them.
LINE_ONLY = (
    "captured_date",
    "cancelled_order_line_sub_total",
    "is_confirmed",
    "line_created",
    "line_is_cancelled",
    "line_org_id",
    "max_return_status_id",
    "order_line_sub_total",
    "promised_delivery",
)


def join_spine(release_facts: DataFrame, line_facts: DataFrame) -> DataFrame:
    lines = line_facts.drop("order_id", *LINE_ONLY)
    return release_facts.join(lines, join_keys(release_facts, lines, "order_pk", "order_line_id"), "left")


def parquet_tables(spark: SparkSession, folder: str) -> Tables:
    """Tables stored as ``folder/<name>``, plain or laid out by date (see ``sources.layout``)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    stored = {s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}

    def load(name: str) -> DataFrame:
        if name not in stored or name not in SCHEMAS.keys() | set(map(by_update, SCHEMAS)):
            raise KeyError(name)
        return spark.read.parquet(f"{folder}/{name}")

    return Tables(load)


def catalog_tables(spark: SparkSession, names: Mapping[str, str]) -> Tables:
    """Tables of the session catalog; ``names`` maps each logical name to a table or view."""
    return Tables(lambda name: spark.table(names[name]))


def jdbc_options(
    url: str, table: str, key: str, bounds: tuple[int, int], partitions: int, **options: str
) -> dict[str, str]:
    """Reader options for a parallel scan in ``partitions`` ranges of the integer column ``key``."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": key,
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(partitions),
        **options,
    }


def jdbc_tables(spark: SparkSession, sources: Mapping[str, Mapping[str, str]]) -> Tables:
    """Tables of a live database; ``sources`` gives the reader options per logical name (see ``jdbc_options``)."""
    return Tables(lambda name: spark.read.format("jdbc").options(**sources[name]).load())
