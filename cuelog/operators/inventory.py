"""File inventories and catalogs: retention, cache eviction, sizes, reconciliation, routes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as o

DAY = 86400


def retention_plan(inventory: DataFrame, as_of: Column, days: int = 120, keep_n: int = 80) -> DataFrame:
    """Delete what is older than ``days`` or not among the ``keep_n`` newest of its root.

    Input: root, path, mtime (s); a path is unique in its root.
    """
    newest = inventory.withColumn("_back", -F.col("mtime"))
    ranked = o.ordered_scan(newest, ["root"], ["_back", "path"], o.every("_back", 30 * DAY), _n=o.row_number())
    old = F.col("mtime") < as_of - days * DAY
    reason = F.when(old, "expired").when(F.col("_n") > keep_n, "beyond_newest").otherwise("")
    return ranked.withColumn("reason", reason).withColumn("delete", F.col("reason") != "").drop("_back", "_n")


def cache_eviction_plan(entries: DataFrame, as_of: Column, retention_days: int = 7, prepared_hours: int = 24,
                        orphan_hours: int = 24, max_bytes: int = 2 << 30, target_bytes: int = 1536 << 20,
                        active: DataFrame | None = None) -> DataFrame:
    """Which cache entries to delete, and why, per (root, key).

    ``entries``: root, key, suffix, size, mtime, provider.  ``active``: root, key
    in use.  Age rules come first; if what is left exceeds ``max_bytes``, prepared
    sounds go first, then the oldest, until ``target_bytes`` are left.
    """
    groups = entries.groupBy("root", "key").agg(
        F.max("mtime").alias("last_used"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("files"),
        F.max(F.col("suffix").isin(".mp3", ".wav")).alias("_sound"), F.max(F.col("suffix") == ".json").alias("_note"),
        F.max((F.col("suffix") == ".json") & F.startswith("provider", F.lit("prepared_wav_"))).alias("_prepared"))
    if active is not None:
        groups = groups.join(active.select("root", "key", F.lit(True).alias("_active")).distinct(), ["root", "key"], "left")
    else:
        groups = groups.withColumn("_active", F.lit(False))
    in_use = F.coalesce("_active", F.lit(False))
    age = F.greatest(F.lit(0), as_of - F.col("last_used"))
    whole = F.col("_sound") & F.col("_note")
    rule = (F.when(~whole, F.when(age >= orphan_hours * 3600, "orphan").otherwise("young_orphan"))
            .when(age >= retention_days * DAY, "stale")
            .when(F.col("_prepared") & (age >= prepared_hours * 3600), "prepared").otherwise(""))
    ruled = groups.withColumn("_rule", rule).withColumn(
        "_gone", ~in_use & F.col("_rule").isin("orphan", "stale", "prepared"))
    totals = ruled.groupBy("root").agg(F.sum(F.when(~F.col("_gone"), F.col("size")).otherwise(0)).alias("_total"))
    # candidates in order of eviction: prepared first, oldest first, then by key
    ruled = ruled.withColumn("_class", F.when(F.col("_prepared"), 0).otherwise(1)).withColumn(
        "_block", F.col("_class") * 10_000_000 + F.floor(F.col("last_used") / DAY))
    frees = F.when((F.col("_rule") == "") & ~in_use, F.col("size")).otherwise(0)
    line = o.ordered_scan(ruled, ["root"], ["_class", "last_used", "key"], "_block", _freed=o.sum_before(frees))
    target = min(target_bytes, max_bytes)
    left = F.col("_total") - F.col("_freed")
    evict = ((F.lit(max_bytes) > 0) & (F.col("_rule") == "") & ~in_use & (F.col("_total") > max_bytes) & (left > target))
    reason = F.when(F.col("_gone"), F.col("_rule")).when(evict, "size_limited").otherwise("")
    return (line.join(totals, "root").withColumn("reason", reason).withColumn("delete", F.col("reason") != "")
            .select("root", "key", "size", "files", "last_used", "delete", "reason"))


def retention_totals(plan: DataFrame) -> DataFrame:
    """Entries, files and bytes deleted per root, what remains, and counts by reason."""
    gone = F.col("delete")
    return plan.groupBy("root").agg(
        F.count_if(gone).alias("deleted_entries"), F.coalesce(F.sum(F.when(gone, F.col("files"))), F.lit(0)).alias("deleted_files"),
        F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0)).alias("freed_bytes"),
        F.coalesce(F.sum(F.when(~gone, F.col("size"))), F.lit(0)).alias("remaining_bytes"),
        *[F.count_if(F.col("reason") == r).alias(f"{r}_entries") for r in ("orphan", "stale", "prepared", "size_limited")])


def inventory_size(inventory: DataFrame) -> DataFrame:
    """Bytes and files per root."""
    return inventory.groupBy("root").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))


def reconcile_catalog(catalog: DataFrame, inventory: DataFrame, manifests: DataFrame) -> DataFrame:
    """State of every installed or once installed item.

    ``catalog``: id, fingerprint.  ``inventory``: id, integrity ('ok' or what is
    wrong).  ``manifests``: id, installed_fingerprint.
    """
    rows = (catalog.select("id", "fingerprint").join(inventory.select("id", "integrity"), "id", "left")
            .join(manifests.select("id", "installed_fingerprint"), "id", "left")
            .filter(F.col("integrity").isNotNull() | F.col("installed_fingerprint").isNotNull()))
    broken = F.coalesce("integrity", F.lit("missing")) != "ok"
    changed = F.coalesce(F.col("installed_fingerprint") != F.col("fingerprint"), F.lit(False)) & (
        F.col("installed_fingerprint") != "")
    action = F.when(broken, "repair_needed").when(changed, "update_available").otherwise("healthy")
    return rows.select("id", action.alias("action"),
                       F.when(broken, F.coalesce("integrity", F.lit("incomplete"))).when(changed, "catalog_changed").otherwise("").alias("reason"),
                       F.lit(True).alias("can_update"), F.coalesce("integrity", F.lit("incomplete")).alias("integrity"))


def plan_routes(requests: DataFrame, pairs: DataFrame, hub="en") -> DataFrame:
    """Shortest installed route src -> tgt: direct, over the hub, or none.  ``pairs``: src, tgt."""
    known = pairs.select("src", "tgt").distinct()
    hub = F.lit(hub)
    direct = known.withColumn("_direct", F.lit(True))
    to_hub = known.filter(F.col("tgt") == hub).select("src", F.lit(True).alias("_in"))
    from_hub = known.filter(F.col("src") == hub).select("tgt", F.lit(True).alias("_out"))
    rows = requests.join(direct, ["src", "tgt"], "left").join(to_hub, "src", "left").join(from_hub, "tgt", "left")
    one = F.struct(F.col("src"), F.col("tgt"))
    via = (F.col("src") != hub) & (F.col("tgt") != hub) & F.col("_in") & F.col("_out")
    h = hub.cast(requests.schema["src"].dataType)
    hops = (F.when(F.col("_direct"), F.array(one))
            .when(via, F.array(F.struct(F.col("src"), h.alias("tgt")), F.struct(h.alias("src"), F.col("tgt")))))
    return rows.select("src", "tgt", hops.alias("hops"), F.coalesce(F.size(hops), F.lit(0)).alias("n_hops"))


def voice_order(voices: DataFrame, preferred: str | None, language: str, usable: str = "usable") -> DataFrame:
    """Usable voices of a language, the preferred one first, then catalog order.

    ``voices``: id, type, language, ord, and a flag.  The ``rank`` sorts one
    catalog, whose size is the number of installed models.
    """
    kept = voices.filter((F.col("type") == "voice") & (F.col("language") == language) & F.col(usable))
    first = F.when(F.col("id") == preferred, 0).otherwise(1) if preferred else F.lit(1)
    numbered = o.ordered_scan(kept.withColumn("_first", first), ["language"], ["_first", "ord"],
                              (F.col("_first") * 1_000_000 + F.floor(F.col("ord") / 10000)), rank=o.row_number())
    return numbered.drop("_first")


def cap_rows(df: DataFrame, keys: Iterable[str], order: str, n: int = 200) -> DataFrame:
    """First ``n`` rows per key with the full count: total_count, shown_count, truncated."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_count"))
    window = Window.partitionBy(*keys).orderBy(order)
    shown = df.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= n).drop("_n")
    return (shown.join(counts, keys).withColumn("shown_count", F.least("total_count", F.lit(n)))
            .withColumn("truncated", F.col("total_count") > n))
