"""Schemas and fixed reference data of the auction-lot model."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of stored files.
LOTS = T.StructType([
    T.StructField("trade_date", T.StringType()), T.StructField("species_raw", T.StringType()), T.StructField("species", T.StringType()),
    T.StructField("state", T.StringType()), T.StructField("origin", T.StringType()), T.StructField("spec", T.StringType()),
    T.StructField("packaging", T.StringType()), T.StructField("quantity", T.DoubleType()), T.StructField("price_high", T.LongType()),
    T.StructField("price_low", T.LongType()), T.StructField("price_avg", T.LongType()),
])
COASTAL_WEATHER = (
    "date string, location string, location_name string, temperature_2m_max double, temperature_2m_min double, temperature_2m_mean double, "
    "precipitation_sum double, wind_speed_10m_max double, wind_gusts_10m_max double, pressure_msl_mean double, sunshine_duration double"
)
RETAIL = "date string, item_name string, item_code string, kind_code string, type string, price string"
CHECKPOINT = "last_updated string, status string, last_completed_date string, statistics struct<total_days_crawled:bigint,total_records:bigint,failed_dates:array<string>>"

# Fixed values.
STATE_NAMES = {"선": "fresh", "활": "live", "냉": "frozen", "가공": "processed", "냉건": "frozen_dried", "건": "dried"}
SPECIES_ALIASES = {
    "고둥 갯고동": "고등 갯고동", "망둑어": "망둥어", "쭈구미": "쭈꾸미", "학공치": "학꽁치", "깐우렁": "깐우렁이", "갑오징어기타": "갑오징어 기타",
}
FOREIGN_KEYWORDS = [
    "일본", "중국", "미국", "러시아", "캐나다", "노르웨이", "뉴질랜드", "대만", "칠레", "아르헨티나", "영국", "아일랜드", "온두라스", "북한", "(원양)", "인도",
    "인도네시아", "태국", "베트남", "필리핀", "호주", "스페인", "네덜란드", "페루", "모로코", "아프리카", "파키스탄", "라스팔마스", "포클랜드", "멕시코",
]
HOLIDAYS = [
    (2018, "seollal", "2018-02-16"), (2018, "chuseok", "2018-09-24"), (2019, "seollal", "2019-02-05"), (2019, "chuseok", "2019-09-13"),
    (2020, "seollal", "2020-01-25"), (2020, "chuseok", "2020-10-01"), (2021, "seollal", "2021-02-12"), (2021, "chuseok", "2021-09-21"),
    (2022, "seollal", "2022-02-01"), (2022, "chuseok", "2022-09-10"), (2023, "seollal", "2023-01-22"), (2023, "chuseok", "2023-09-29"),
    (2024, "seollal", "2024-02-10"), (2024, "chuseok", "2024-09-17"), (2025, "seollal", "2025-01-29"), (2025, "chuseok", "2025-10-06"),
]
NO_DATA = "조회된 경락시세가 없습니다"
