"""Style-factor list of the vendor's risk model and its daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Type, code and name of every factor, in the published order.
FACTORS = [
    ("国家因子", "CNE5S_COUNTRY", "国家"),
    ("风格因子", "CNE5S_BETA", "BETA"),
    ("风格因子", "CNE5S_SIZE", "规模"),
    ("风格因子", "CNE5S_EARNYILD", "经营收益率"),
    ("风格因子", "CNE5S_RESVOL", "残差波动率"),
    ("风格因子", "CNE5S_GROWTH", "成长"),
    ("风格因子", "CNE5S_BTOP", "账面市值比"),
    ("风格因子", "CNE5S_LEVERAGE", "杠杆"),
    ("风格因子", "CNE5S_LIQUIDTY", "流动性"),
    ("风格因子", "CNE5S_SIZENL", "非线性规模"),
    ("风格因子", "CNE5S_MOMENTUM", "动量"),
    ("行业因子", "CNE5S_ENERGY", "能源"),
    ("行业因子", "CNE5S_CHEM", "化学品"),
    ("行业因子", "CNE5S_CONMAT", "建筑材料"),
    ("行业因子", "CNE5S_MTLMIN", "特殊金属"),
    ("行业因子", "CNE5S_MATERIAL", "材料"),
    ("行业因子", "CNE5S_AERODEF", "航空和国防"),
    ("行业因子", "CNE5S_BLDPROD", "建筑产品"),
    ("行业因子", "CNE5S_CNSTENG", "建筑和工程"),
    ("行业因子", "CNE5S_ELECEQP", "电子设备"),
    ("行业因子", "CNE5S_INDCONG", "工业综合类"),
    ("行业因子", "CNE5S_MACH", "工业机械"),
    ("行业因子", "CNE5S_TRDDIST", "贸易公司和分销"),
    ("行业因子", "CNE5S_COMSERV", "商业及专业服务"),
    ("行业因子", "CNE5S_AIRLINE", "航空公司"),
    ("行业因子", "CNE5S_MARINE", "船舶"),
    ("行业因子", "CNE5S_RDRLTRAN", "公路铁路和运输基础设施"),
    ("行业因子", "CNE5S_AUTO", "汽车及其零配件"),
    ("行业因子", "CNE5S_HOUSEDUR", "家庭耐用品"),
    ("行业因子", "CNE5S_LEISLUX", "纺织品服装和奢侈品"),
    ("行业因子", "CNE5S_CONSSERV", "消费服务"),
    ("行业因子", "CNE5S_MEDIA", "媒体"),
    ("行业因子", "CNE5S_RETAIL", "零售"),
    ("行业因子", "CNE5S_PERSPRD", "食品零售家用及个人消费品"),
    ("行业因子", "CNE5S_BEV", "饮料"),
    ("行业因子", "CNE5S_FOODPROD", "食品"),
    ("行业因子", "CNE5S_HEALTH", "健康"),
    ("行业因子", "CNE5S_BANKS", "银行"),
    ("行业因子", "CNE5S_DVFININS", "多元化金融服务"),
    ("行业因子", "CNE5S_REALEST", "房地产"),
    ("行业因子", "CNE5S_SOFTWARE", "软件"),
    ("行业因子", "CNE5S_HDWRSEMI", "硬件和半导体"),
    ("行业因子", "CNE5S_UTILITIE", "公共事业"),
]
#: Daily series of a factor.
SERIES = ["factor_mom", "factor_std", "pb", "turnover", "crowd"]


def factor_table(spark: SparkSession) -> DataFrame:
    """(pos, type, code, name) of all factors."""
    return spark.createDataFrame([(i, *f) for i, f in enumerate(FACTORS)], "pos long, type string, code string, name string")


def with_series(table: DataFrame, series: DataFrame) -> DataFrame:
    """Daily rows of all factors; a factor without any keeps one row without a day.

    The factor list is fixed and short, so it is broadcast; factors without a series are
    added by an anti join on the distinct codes seen.
    """
    found = series.join(F.broadcast(table), "code")
    none = table.join(series.select("code").distinct(), "code", "left_anti")
    return found.unionByName(none, allowMissingColumns=True)
