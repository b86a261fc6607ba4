"""Fact types and helpers of the scenario tests."""

from lemmata import FactType, Rulebase, Session
from lemmata.tools.testing import bag, rows

__all__ = ["TYPES", "bag", "rows", "start"]
TYPES = [
    FactType("Temperature", "temperature bigint, location string"),
    FactType("WindSpeed", "windspeed bigint, location string"),
    FactType("Cold", "temperature bigint"),
    FactType("Hot", "temperature bigint"),
    FactType("ColdAndWindy", "temperature bigint, windspeed bigint"),
    FactType("LousyWeather", "__unit boolean"),
    FactType("TemperatureHistory", "temperatures array<bigint>"),
]


def start(spark, *productions, types=(), **options):
    return Session(Rulebase([*TYPES, *types], productions), spark, **options)
