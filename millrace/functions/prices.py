"""Prices in texts, currencies, trade terms: Column to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, places: int) -> Column:
    """Half up in decimal terms: 2.675 that binary arithmetic left a little lower still goes up."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + F.signum(value) * 1e-9, places)


NUMBER = r"[\d,]+(?:\.\d+)?"
#: Fixed symbols and codes, asked in this order.
CURRENCIES = (("$", "USD"), ("USD", "USD"), ("€", "EUR"), ("EUR", "EUR"), ("£", "GBP"), ("GBP", "GBP"), ("¥", "CNY"), ("￥", "CNY"), ("RMB", "CNY"), ("₦", "NGN"), ("NGN", "NGN"), ("₹", "INR"), ("INR", "INR"))
#: Fixed yuan per unit for price texts.
YUAN = {"USD": 7.2, "EUR": 7.8, "GBP": 9.0, "NGN": 0.01, "INR": 0.087}
#: Fixed default units per US dollar.
RATES = {"USD": 1.0, "CNY": 7.2, "EUR": 0.92, "GBP": 0.79, "JPY": 149.5, "KRW": 1320.0, "INR": 83.0, "BRL": 4.97, "RUB": 92.0, "VND": 24500.0, "THB": 35.5, "MYR": 4.7, "SGD": 1.34, "PHP": 55.5, "IDR": 15600.0}
SYMBOLS = {"CNY": "¥", "USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥"}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once a row; a Column that is named in several places is worked out in each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))


def extract_numbers(text: Column) -> Column:
    """All numbers, with thousands commas taken out, as an array of doubles."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(",")).try_cast("double")), lambda x: x.isNotNull())


def detect_currency(text: Column) -> Column:
    upper = F.upper(F.coalesce(text, F.lit("")))
    out = F.lit("CNY")
    for sign, code in reversed(CURRENCIES):
        out = F.when(upper.contains(sign), code).otherwise(out)
    return out


def clean_price(text: Column, yuan: dict[str, float] = YUAN) -> Column:
    """Yuan for a price text: discounts, the mean of a range, K and W multipliers, other currencies."""

    def yuan_of(x: Column) -> Column:
        t, numbers, low, upper = x["t"], x["numbers"], x["low"], x["upper"]
        first, second, n = F.try_element_at(numbers, F.lit(1)), F.try_element_at(numbers, F.lit(2)), F.size(numbers)
        rate = F.lit(1.0)
        for sign, code in reversed(CURRENCIES):
            rate = F.when(upper.contains(sign), yuan.get(code, 1.0)).otherwise(rate)
        times = F.when(upper.rlike(r"\dK\b") & ~upper.contains("KG"), 1000).when(upper.rlike(r"\dW\b"), 10000).otherwise(1)
        ranged = t.contains("-") | t.contains("~") | low.contains("or")
        return (
            F.when(t == "", None).when(t.contains("折") & (n > 0), first / 10)
            .when(t.contains("%") & low.contains("off") & (n > 0), first * 0.01)
            .when(ranged & (n >= 2), (first + second) / 2).when(ranged & (n == 1), first).when(n > 0, first * times * rate)
        )

    t = blank(text)
    return let(F.struct(t.alias("t"), extract_numbers(t).alias("numbers"), F.lower(t).alias("low"), F.upper(t).alias("upper")), yuan_of)


def number_price(value: Column) -> Column:
    """A numeric price stays if above 0."""
    return F.when(value > 0, value.cast("double"))


def cell_price(text: Column) -> Column:
    """A cell that is a number counts if above 0; other texts as clean_price has them."""
    number = let(blank(text).try_cast("double"), lambda number: F.when(number.isNotNull(), number_price(number)).otherwise(clean_price(text)))
    return F.when(blank(text) != "", number)


#: How prices are written in dollars, in yuan, and without a currency.
_USD = (r"(?i)(?:USD|US\s*Dollar)\s*([\d,]+(?:\.\d+)?)", r"(?i)([\d,]+(?:\.\d+)?)\s*(?:USD|US\s*Dollar)")
_CNY = (r"(?i)(?:¥|CNY|RMB|人民币)\s*([\d,]+(?:\.\d+)?)", r"(?i)([\d,]+(?:\.\d+)?)\s*(?:元|RMB|CNY)")
_PLAIN = r"(?<!\d)([\d,]+(?:\.\d+)?)(?!\d*\s*[WVKA%a-z]|\s*(?:Kg|KM|Nm|mm|Hz|rpm))"


def price_from_value(text: Column, usd_rate: float = 7.2) -> Column:
    """(price, price_cny, currency) or null: dollars, else yuan, else a bare number between 0.01 and 1e6."""

    def first(t: Column, *patterns: str) -> Column:
        found = [let(F.regexp_extract(t, p, 1), lambda x: F.when(x != "", x)) for p in patterns]
        return F.replace(F.coalesce(*found), F.lit(",")).try_cast("double")

    make = lambda price, yuan, code: F.struct(price.alias("price"), yuan.alias("price_cny"), F.lit(code).alias("currency"))

    def priced(t: Column) -> Column:
        plain = let(first(t, _PLAIN), lambda x: F.when((x > 0.01) & (x < 1_000_000), make(x, x, "CNY")))
        cny = let(first(t, *_CNY), lambda x: F.when(x > 0, make(x, x, "CNY")).otherwise(plain))
        return let(first(t, *_USD), lambda x: F.when(x > 0, make(x, rounded(x * usd_rate, 2), "USD")).otherwise(cny))

    return let(blank(text), priced)


#: Fixed words before a price, asked in this order.
PRICE_WORDS = ("price", "单价", "价格", "售价", "金额", "total", "总额", "小计", "合计", "$", "¥", "usd")


def clean_price_text(text: Column) -> Column:
    """The first number after a price word, else the first number."""
    s = F.translate(F.coalesce(text, F.lit("")), ",，", "")
    low = F.lower(s)
    found = []
    for w in PRICE_WORDS:
        at = F.instr(low, w)
        found.append(F.when(at > 0, F.nullif(F.regexp_extract(F.substring(s, at + len(w), F.length(s)), r"\d+(?:\.\d+)?", 0), F.lit(""))))
    return F.coalesce(*found, F.nullif(F.regexp_extract(s, r"\d+(?:\.\d+)?", 0), F.lit(""))).try_cast("double")


def clean_price_number(value: Column) -> Column:
    return F.when((value > 0.01) & (value < 1_000_000), value.cast("double"))


def validate_price(value: Column, low: float = 0.01, high: float = 999_999.0) -> Column:
    return F.coalesce((value > 0) & value.between(low, high), F.lit(False))


def price_from_string(text: Column) -> Column:
    found = F.replace(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), NUMBER, 0), F.lit("")), F.lit(",")).try_cast("double")
    return F.when(validate_price(found), found)


def is_price_marker(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(r"price|价格|单价|exw|fob|cif|出厂价|报价|rmb|usd")


def reasonable_price(price: Column, year: int) -> Column:
    """Not a year near `year`, between 0.01 and ten million."""
    is_year = price.between(max(year - 3, 2000), min(year + 5, 2100)) & (price == F.floor(price))
    return F.coalesce(~is_year & (price >= 0.01) & (price < 10_000_000), F.lit(False))


def rate_of(currency: Column, rates: dict[str, float] = RATES) -> Column:
    """Units per dollar, 1 for an unknown currency."""
    table = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(currency)), F.lit(1.0))


def fx_convert(amount: Column, source: Column, target: Column, rates: dict[str, float] = RATES) -> Column:
    return rounded(amount * (rate_of(target, rates) / rate_of(source, rates)), 2)


def format_price(value: Column, currency: Column) -> Column:
    code = F.upper(currency)
    sign = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv]), code), code)
    return F.when(value.isNull(), "").otherwise(F.concat(sign, F.when(code == "JPY", F.format_number(value, 0)).otherwise(F.format_number(value, 2))))


def fob_price(rmb: Column, rate: float, fees: float = 0.0) -> Column:
    return F.coalesce(rounded((rmb + fees) / rate, 2), F.lit(0.0))


def cif_price(rmb: Column, rate: float, fees: float = 0.0, freight: float = 0.0, insurance: float = 0.0) -> Column:
    fob = (rmb + fees) / rate
    return F.coalesce(rounded(fob + freight + fob * insurance, 2), F.lit(0.0))


#: Fixed order of trade terms, each with all costs of the ones it adds to.
TERMS = ("EXW", "FOB", "CFR", "CIF", "DAP", "DDP")


def trade_term(base: Column, qty: Column, term: Column, *, weight: Column, cbm: Column, per_cbm=120.0, insurance=0.001, duty=0.10, clearance=200.0, delivery=500.0) -> dict[str, Column]:
    """Goods, freight, insurance, duty, other cost and total of a line, in the currency of the base price."""
    zero = F.lit(0.0)
    goods = base * qty
    volume = F.when((weight > 0) & (cbm > 0), F.greatest(cbm, weight / 500)).when(cbm > 0, cbm).otherwise(0.5 * qty)
    shipped, insured, cleared = term != "EXW", term.isin("CIF", "DAP", "DDP"), term.isin("DAP", "DDP")
    freight = F.when(shipped, volume * per_cbm).otherwise(zero)
    ins = F.when(insured, (goods + freight) * insurance).otherwise(zero)
    tax = F.when(cleared, goods * duty).otherwise(zero)
    other = F.when(shipped, F.lit(clearance)).otherwise(zero) + F.when(term == "DDP", F.lit(delivery)).otherwise(zero)
    return {"goods": goods, "freight": freight, "insurance": ins, "duty": tax, "other": other, "total": goods + freight + ins + tax + other}


def classify_price(item: Column, primary: list[str], secondary: list[tuple[str, list[str], str]]) -> Column:
    """(type, label, is_primary): first keyword that the name contains, primary words first."""
    low = F.lower(blank(item))
    make = lambda kind, label, is_primary: F.struct(F.lit(kind).alias("type"), label.alias("label"), F.lit(is_primary).alias("is_primary"))
    has = lambda words: low.rlike("|".join(_quoted(w.lower()) for w in words)) if words else F.lit(False)
    out = F.when(low == "", make("unclassified", item, False)).when(has(primary), make("primary", item, True))
    for kind, words, label in secondary:
        out = out.when(has(words), make(kind, F.lit(label), False))
    return out.otherwise(make("unclassified", item, False))


def _quoted(word: str) -> str:
    import re

    return re.escape(word)


#: Fixed words of the vehicle price classes.
EV_PRIMARY = ["整车价格", "EV", "出厂价格", "裸车价格", "裸车价", "CKD散件价格", "CKD", "unit price", "整车", "complete vehicle", "EXW PRICE", "价格"]
EV_SECONDARY = [
    ("battery", ["电池", "battery", "锂电池", "铅酸电池", "磷酸铁锂", "锂电"], "Battery Price"),
    ("charger", ["充电器", "charger"], "Charger Price"),
    ("packing", ["包装", "packing", "packaging", "包装费"], "Packing Fee"),
    ("freight", ["运费", "freight", "shipping", "海运"], "Freight"),
    ("controller", ["控制器", "controller"], "Controller Price"),
    ("motor", ["电机", "motor", "马达"], "Motor Price"),
    ("accessory", ["配件", "accessory", "附件"], "Accessory Price"),
    ("insurance", ["保险", "insurance"], "Insurance"),
]


def detect_industry(file_name: Column, default: str = "ev") -> Column:
    low = F.lower(F.coalesce(file_name, F.lit("")))
    return F.when(low.rlike(r"\bev\b|电动车|电动|electric"), "ev").when(low.rlike(r"medical|医疗|医疗器械|医药"), "medical").otherwise(F.lit(default))


def resolve_price(prices: Column, strategy: str) -> Column:
    """One of an array of candidate prices; the most common one is the earliest of equals."""
    if strategy == "first":
        return F.try_element_at(prices, F.lit(1))
    if strategy == "last":
        return F.try_element_at(prices, F.lit(-1))
    if strategy == "smallest":
        return F.array_min(prices)
    if strategy == "most_common":
        counted = F.transform(prices, lambda x: F.struct(F.size(F.filter(prices, lambda y: y == x)).alias("n"), (-F.array_position(prices, x)).alias("place"), x.alias("price")))
        return F.array_max(counted)["price"]
    return F.array_max(prices)


def target_currency_price(price: Column, source: Column, target: str, rate: float = 7.2) -> Column:
    return F.when((target == F.lit("USD")) & (source != "USD"), price / rate).when((target == F.lit("CNY")) & (source == "USD"), price * rate).otherwise(price)


def moq_check(qty: Column, moq: Column) -> Column:
    return F.struct((qty >= moq).alias("valid"), F.when(qty < moq, moq).alias("suggested_qty"))
