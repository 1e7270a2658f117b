"""Daily briefing (P19): weather lines, vehicle lines and a rule cascade of advice,
for every entity at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.operators.telemetry import telemetry_current

# Briefing texts (``{}`` slots are filled in order).
HEADER = "🌅 **Bom dia! Briefing de {}**\n"
WEATHER_1 = "🌡️ **Clima**: {}, {}°C (sensação {}°C)"
WEATHER_2 = "   Min {}° / Máx {}° — Umidade {}% — UV {}"
RAIN_LINE = "   🌧️ **Chuva provável**: {}"
CAR_LINE = "\n🚗 **{}**: {}% — {} km autonomia"
CHARGING = "   ⚡ Carregando agora"
UNLOCKED = "   ⚠️ **DESTRANCADO!**"
RECO_HEADER = "\n💡 **Recomendação**:"
BATTERY_CRITICAL = "🔴 Bateria crítica — carregue AGORA antes de sair"
BATTERY_LOW_RAIN = "🟡 Bateria baixa + chuva prevista — carregue hoje (AC consome mais)"
BATTERY_LOW = "🟡 Bateria baixa — considere carregar hoje"
BATTERY_OK = "🟢 Bateria OK para o dia, mas programe carga nos próximos dias"
BATTERY_GOOD = "✅ Bateria boa, sem necessidade de carga"
RAIN_UNLOCKED = "⚠️ Chuva prevista e carro destrancado — tranque!"
JUST_UNLOCKED = "⚠️ Carro destrancado — tranque!"
UMBRELLA = "☂️ Leve guarda-chuva — chuva prevista a partir das {}h"
RECO_INDENT = "   "


def fill(template: str, *cols: Column) -> Column:
    parts = template.split("{}")
    out: list[Column] = [F.lit(parts[0])]
    for c, lit in zip(cols, parts[1:]):
        out += [c.cast("string"), F.lit(lit)]
    return F.concat(*out)


def daily_briefing(telemetry: DataFrame, weather: DataFrame | None, as_of, vehicle_label: str) -> DataFrame:
    """One briefing per entity: latest snapshot (P1) LEFT JOIN the forecast of ``as_of``.

    ``weather`` is the output of ``ingest_weather`` with a ``date`` column (one row per
    forecast day); the row of ``as_of`` is read once as a scalar subquery."""
    cur = telemetry_current(telemetry.select("entity_id", "timestamp", "battery_soc", "battery_range_km", "is_charging", "is_locked"))
    day = F.lit(as_of).cast("date")
    cur = cur.withColumn("briefing_date", day)
    if weather is not None:
        # The day's forecast is one row: an uncorrelated scalar subquery (max of a
        # struct keeps it a single deterministic row), evaluated once per query.
        fields = ["description", "temp", "feels_like", "min", "max", "humidity", "uv", "rain_hours"]
        fc = weather.filter(F.col("date") == day).agg(F.max(F.struct(*[F.col(c) for c in fields])).alias("w"))
        cur = cur.withColumn("_w", fc.scalar()).select("*", *[F.col("_w")[c].alias(c) for c in fields]).drop("_w")
        has_w = F.col("description").isNotNull()
        rain = F.coalesce(F.col("rain_hours"), F.array().cast("array<struct<hour: int, chance: int>>"))
    else:
        has_w = F.lit(False)
        rain = F.array().cast("array<struct<hour: int, chance: int>>")
    has_rain = has_w & (F.size(rain) > 0)
    bat = F.col("battery_soc").cast("double")
    locked = F.coalesce(F.col("is_locked"), F.lit(False))
    rain_txt = F.array_join(F.transform(rain, lambda r: F.concat(r["hour"].cast("string"), F.lit("h ("), r["chance"].cast("string"), F.lit("%)"))), ", ")
    battery = (F.when(bat <= 20, F.lit(BATTERY_CRITICAL))
               .when((bat <= 40) & has_rain, F.lit(BATTERY_LOW_RAIN)).when(bat <= 40, F.lit(BATTERY_LOW))
               .when(bat <= 60, F.lit(BATTERY_OK)).otherwise(F.lit(BATTERY_GOOD)))
    lock_reco = F.when(has_rain & ~locked, F.lit(RAIN_UNLOCKED)).when(~locked, F.lit(JUST_UNLOCKED))
    umbrella = F.when(has_rain, fill(UMBRELLA, F.get(rain, 0)["hour"]))
    recos = F.array_compact(F.array(battery, lock_reco, umbrella))
    lines = F.array_compact(F.array(
        fill(HEADER, F.date_format(day, "dd/MM")),
        F.when(has_w, fill(WEATHER_1, F.col("description"), F.col("temp"), F.col("feels_like"))) if weather is not None else F.lit(None).cast("string"),
        F.when(has_w, fill(WEATHER_2, F.col("min"), F.col("max"), F.col("humidity"), F.col("uv"))) if weather is not None else F.lit(None).cast("string"),
        F.when(has_rain, fill(RAIN_LINE, rain_txt)),
        fill(CAR_LINE, F.lit(vehicle_label), bat, F.col("battery_range_km").cast("double")),
        F.when(F.coalesce(F.col("is_charging"), F.lit(False)), F.lit(CHARGING)),
        F.when(~locked, F.lit(UNLOCKED)),
        F.lit(RECO_HEADER),
    ))
    lines = F.concat(lines, F.transform(recos, lambda r: F.concat(F.lit(RECO_INDENT), r)))
    return cur.select("entity_id", F.col("briefing_date").alias("date"), recos.alias("recommendations"),
                      F.array_join(lines, "\n").alias("text"))
