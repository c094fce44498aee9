"""Table and feed schemas, seeds and code lookups. The values are fixed."""

from __future__ import annotations

#: Tables: DDL of the columns, key, not-null columns, text lengths.
MARKET = "ID int, Symbol string, Name string, EnName string, CreateDate timestamp, UpdateDate timestamp, DeleteDate timestamp"
SECURITY_TYPE = MARKET
SECURITY = (
    "ID int, Symbol string, Name string, EnName string, ListedShare bigint, MarketCapitalization bigint, Market_ID int, SecurityType_ID int, "
    "CreateDate timestamp, UpdateDate timestamp, DelistDate timestamp"
)
STAGED_SECURITY = "ID int, Symbol string, Name string, EnName string, Market_ID int, CreateDate timestamp"
CHECKPOINT = "ID int, CurrentStartInterval timestamp, CurrentSymbol string"
NOT_NULL = {"market": ("ID", "Symbol", "Name", "EnName", "CreateDate"), "security": ("ID", "Symbol", "Market_ID", "CreateDate"), "checkpoint": ("ID", "CurrentStartInterval", "CurrentSymbol")}
LENGTHS = {"market": {"Symbol": 5, "Name": 200, "EnName": 200}, "security_type": {"Symbol": 2, "Name": 30, "EnName": 30}, "security": {"Symbol": 12, "Name": 200, "EnName": 200}}

#: Seed rows: symbol, name, English name.
MARKETS = (
    ("HNX", "Sở Giao dịch Chứng khoán Hà Nội", "Hanoi Stock Exchange"),
    ("HOSE", "Sở Giao dịch Chứng khoán Thành phố Hồ Chí Minh", "Ho Chi Minh City Stock Exchange"),
    ("UPCOM", "Hệ Thống Giao Dịch Cho Chứng Khoán Chưa Niêm Yết", "Unlisted Public Company Market"),
    ("DER", "Chứng Khoán Phái Sinh", "Derivatives Market"),
    ("BOND", "Trái Phiếu", "Bond Market"),
)
SECURITY_TYPES = (
    ("ST", "Cổ phiếu", "Stock"),
    ("CW", "Chứng quyền có bảo đảm", "Covered Warrant"),
    ("FU", "Hợp đồng tương lai", "Futures"),
    ("EF", "Quỹ hoán đổi danh mục", "Exchange Traded Fund"),
    ("BO", "Trái phiếu", "BOND"),
    ("OF", "Quỹ mở", "Open-ended Funds"),
    ("MF", "Quỹ tương hỗ", "Mutual Fund"),
)
#: Codes that feeds use beside a market's symbol.
MARKET_ALIASES = {"DERIVATIVES": "DER"}
SESSIONS = {
    "ATO": "Opening Call Auction",
    "LO": "Continuous Trading",
    "ATC": "Closing All Auction",
    "PT": "Putthrough",
    "C": "Market Close",
    "BREAK": "Lunch Break",
    "HALT": "Market Halt",
}

_TEXT = lambda names: "struct<" + ", ".join(f"{n}: string" for n in names.split()) + ">"
DETAIL = _TEXT(
    "Isin Symbol SymbolName SymbolEngName SecType MarketId Exchange Issuer LotSize IssueDate MaturityDate FirstTradingDate LastTradingDate "
    "ContractMultiplier SettlMethod Underlying PutOrCall ExercisePrice ExerciseStyle ExcerciseRatio ListedShare TickPrice1 TickIncrement1 TickPrice2 "
    "TickIncrement2 TickPrice3 TickIncrement3 TickPrice4 TickIncrement4"
)
PRICE_FIELDS = (
    "PriceChange PerPriceChange CeilingPrice FloorPrice RefPrice OpenPrice HighestPrice LowestPrice ClosePrice AveragePrice ClosePriceAdjusted TotalMatchVol TotalMatchVal TotalDealVal "
    "TotalDealVol ForeignBuyVolTotal ForeignCurrentRoom ForeignSellVolTotal ForeignBuyValTotal ForeignSellValTotal TotalBuyTrade TotalBuyTradeVol TotalSellTrade TotalSellTradeVol "
    "NetBuySellVol NetBuySellVal TotalTradedVol TotalTradedValue"
).split()
#: Items of the feeds; every value is text until it is cast.
ITEMS = {
    "securities": _TEXT("Market Symbol StockName StockEnName"),
    "details": f"struct<RType: string, ReportDate: string, TotalNoSym: string, RepeatedinfoList: array<{DETAIL}>>",
    "index_components": f"struct<IndexCode: string, IndexName: string, Exchange: string, TotalSymbolNo: string, IndexComponent: array<{_TEXT('Isin StockSymbol')}>>",
    "index_list": _TEXT("IndexCode IndexName Exchange"),
    "daily_ohlc": _TEXT("Symbol Market TradingDate Time Open High Low Close Volume Value"),
    "intraday_ohlc": _TEXT("Symbol Market TradingDate Time Open High Low Close Volume"),
    "daily_index": _TEXT(
        "IndexCode IndexValue TradingDate Time Change RatioChange TotalTrade TotalMatchVol TotalMatchVal TypeIndex IndexName Advances NoChanges Declines Ceilings Floors TotalDealVol TotalDealVal "
        "TotalVol TotalVal TradingSession"
    ),
    "daily_prices": _TEXT("Symbol TradingDate Time " + " ".join(PRICE_FIELDS)),
}
NESTED = {"details": "RepeatedinfoList", "index_components": "IndexComponent"}
#: Items' whole numbers, decimals and days, by feed.
WHOLE = {
    "daily_prices": [f for f in PRICE_FIELDS if f != "PerPriceChange"],
    "daily_ohlc": "Open High Low Close Volume Value".split(),
    "intraday_ohlc": "Open High Low Close Volume".split(),
    "daily_index": "TotalTrade TotalMatchVol TotalMatchVal Advances NoChanges Declines Ceilings Floors TotalDealVol TotalDealVal TotalVol TotalVal".split(),
}
DECIMAL = {"daily_prices": ["PerPriceChange"], "daily_index": ["IndexValue", "Change", "RatioChange"]}
DAYS = {k: ["TradingDate"] for k in ("daily_prices", "daily_ohlc", "intraday_ohlc", "daily_index")}

MESSAGE = "channel string, symbol string, ts timestamp, price double, volume bigint, _corrupt_record string"


def envelope(feed: str) -> str:
    """DDL of a page of a feed."""
    return f"message string, status int, totalRecord bigint, data array<{ITEMS[feed]}>"
