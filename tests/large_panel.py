"""Times fill and features on a synthetic panel of the original's size.

``python tests/large_panel.py [stations] [hours] [share of all rows in one station]``
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from gapwise.plans.build import feature_table  # noqa: E402
from gapwise.session import local_session  # noqa: E402
from gapwise.spec import PanelSpec  # noqa: E402


def panel(spark, stations: int, hours: int, hot: float):
    """Hourly rows with a tenth of the values missing; repeatable."""
    spec = PanelSpec()
    rows = spark.range(stations * hours)
    at, n = F.col("id"), stations * hours
    own = F.when(at < int(hot * n), 0).otherwise(1 + at % (stations - 1))
    place = F.when(at < int(hot * n), at).otherwise(F.floor(at / (stations - 1)))
    values = [F.when(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(10)) > 0,
                     F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(5000)) / 10.0).alias(c)
              for c in spec.values]
    time_of = F.timestamp_add("HOUR", place.cast("int"), F.lit("2015-01-01").cast("timestamp_ntz"))
    return rows.select(F.concat(F.lit("S"), own.cast("string")).alias("station_id"),
                       time_of.alias("datetime"), *values), spec


def main() -> None:
    stations, hours = (int(x) for x in (sys.argv[1:3] or ("110", "23537")))
    hot = float(sys.argv[3]) if len(sys.argv) > 3 else 0.0
    spark = local_session()
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    rows, spec = panel(spark, stations, hours, hot)
    for _ in range(2):
        start = time.perf_counter()
        feature_table(rows, spec, fill=True).write.format("noop").mode("overwrite").save()
        print(f"{stations * hours} rows: {time.perf_counter() - start:.1f} s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
