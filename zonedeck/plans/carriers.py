"""How the given tables carry mainframe-shaped data.

Each carrier is a list of SQL expressions over one table, in the part of SQL that Spark and
DuckDB share, so the query and its check start from the same definition of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonedeck.layout import Layout
from zonedeck.session import spread


class Carrier:
    def __init__(self, table: str, **columns: str):
        self.table, self.columns = table, columns

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spread(table(spark, sf_dir, self.table))
        return rows.selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])

    @property
    def sql(self) -> str:
        return "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in self.columns.items()) + f" FROM {self.table})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ymd(column: str) -> str:
    return f"CAST(year({column}) * 10000 + month({column}) * 100 + day({column}) AS INT)"


def text_of(*parts: str) -> str:
    """Concatenation; a part starting with ``=`` is an expression, anything else a literal."""
    quoted = [p[1:] if p.startswith("=") else "'" + p.replace("'", "''") + "'" for p in parts]
    return "concat(" + ", ".join(quoted) + ")"


NL = "=chr(10)"

SALE_LAYOUT = Layout.from_copybook("""
       01  SALE.
           05 SALE-RANK      PIC X(15).
           05 SALE-STATE     PIC X(1).
              88 SALE-DONE    VALUE 'F'.
              88 SALE-OPEN    VALUES 'O' 'P'.
           05 SALE-NO        PIC X(19).
           05 SALE-DAY       PIC 9(9)       COMP-3.
              88 SALE-EARLY   VALUE 19920101 THRU 19951231.
           05 SALE-BUYER     PIC S9(18)     COMP.
           05 SALE-WORTH     PIC S9(11)V99  COMP-3.
              88 SALE-LARGE   VALUE 100000 THRU 999999999.99.
""")
SALES = Carrier(
    "orders",
    sale_no="lpad(CAST(o_orderkey AS STRING), 19, '0')",
    sale_rank="o_orderpriority",
    sale_state="o_orderstatus",
    sale_day=ymd("o_orderdate"),
    sale_buyer="CAST(o_custkey AS BIGINT)",
    sale_worth="CAST(o_totalprice AS DECIMAL(13,2))",
)

BUYER_LAYOUT = Layout.from_copybook("""
       01 BUYER.
          05 BUYER-BRANCH   PIC X(10).
          05 BUYER-NO       PIC X(19).
          05 BUYER-CREDIT   PIC S9(11)V99.
          05 BUYER-NAME     PIC X(44).
""")
BUYERS = Carrier(
    "customer",
    buyer_no="lpad(CAST(c_custkey AS STRING), 19, '0')",
    buyer_branch="c_mktsegment",
    buyer_credit="CAST(c_acctbal AS DECIMAL(13,2))",
    buyer_name="c_name",
)

VENDOR_LAYOUT = Layout.from_copybook("""
       01 VENDOR.
          05 VENDOR-LAND    PIC 9(5).
          05 VENDOR-NAME    PIC X(28).
          05 VENDOR-NO      PIC X(19).
          05 VENDOR-FUNDS   PIC 9(8)V99.
""")
VENDORS = Carrier(
    "supplier",
    vendor_no="lpad(CAST(s_suppkey AS STRING), 19, '0')",
    vendor_land="CAST(s_nationkey AS INT)",
    vendor_name="s_name",
    vendor_funds="CAST(abs(s_acctbal) AS DECIMAL(10,2))",
)

STOCK_LAYOUT = Layout.from_copybook("""
       01 STOCK.
          05 STOCK-GAP      PIC S9(3) COMP.
          05 STOCK-NO       PIC X(19).
          05 STOCK-SIZE     PIC 9(3) COMP.
          05 STOCK-KEY      PIC S9(17) COMP.
          05 STOCK-SHIFT    PIC S9(6) COMP.
          05 STOCK-FAR      PIC S9(18) COMP.
""")
STOCKS = Carrier(
    "part",
    stock_no="lpad(CAST(p_partkey AS STRING), 19, '0')",
    stock_gap="CAST(p_size - 25 AS INT)",
    stock_size="CAST(p_size AS INT)",
    stock_key="CAST(p_partkey AS BIGINT)",
    stock_shift="CAST((p_size - 25) * 1001 AS INT)",
    stock_far="CAST(p_size - 25 AS BIGINT) * 100000000000007",
)

SIGNED_LAYOUT = Layout.from_copybook("""
       01 SIGNED-RECORD.
          05 OVER-PUNCHED  PIC S9(9)V99.
          05 SIGN-FIRST    PIC S9(9)V99 SIGN IS LEADING SEPARATE.
          05 SIGN-LAST     PIC S9(9)V99 SIGN IS TRAILING SEPARATE.
""")
SIGNED = Carrier("customer", over_punched="CAST(c_acctbal AS DECIMAL(11,2))",
                 sign_first="CAST(c_acctbal AS DECIMAL(11,2))", sign_last="CAST(-c_acctbal AS DECIMAL(11,2))")

BASKET_LAYOUT = Layout.from_copybook("""
       01 BASKET.
          05 BASKET-HEAD.
             10 BASKET-NO     PIC 9(19).
             10 BASKET-LINES  PIC 9(3).
          05 BASKET-ROW OCCURS 1 TO 4 TIMES DEPENDING ON BASKET-LINES.
             10 ROW-PART      PIC X(19).
             10 ROW-UNITS     PIC 9(4) COMP.
             10 ROW-PRICE     PIC S9(8)V99 COMP-3.
""")

SLIP_LAYOUT = Layout.from_copybook("""
       01 DAY-SLIP.
          05 SLIP-KEY     PIC 9(12).
          05 SLIP-PARTS   REDEFINES SLIP-KEY.
             10 SLIP-SERIAL PIC 9(4).
             10 SLIP-MONTH  PIC 9(6).
             10 SLIP-DAY    PIC 9(2).
""")
SLIPS = Carrier("orders", slip_key=f"(o_orderkey % 9000 + 1000) * 100000000 + {ymd('o_orderdate')}")

_HOURS = "CAST(l_quantity AS DECIMAL(5,2))"
_RATE = "CAST(CAST(10 + l_partkey % 90 AS DECIMAL(7,2)) + CAST(l_discount AS DECIMAL(3,2)) AS DECIMAL(7,2))"
_TAX = "CAST(20 + CAST(l_tax AS DECIMAL(3,2)) * 100 AS DECIMAL(5,2))"
_GROSS = f"CAST(ROUND({_HOURS} * {_RATE}, 2) AS DECIMAL(11,2))"
_TAKEN = f"CAST(ROUND({_GROSS} * {_TAX} * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(11,2))"
_NET = f"CAST({_GROSS} - {_TAKEN} AS DECIMAL(11,2))"
HOURS = Carrier("lineitem", l_orderkey="l_orderkey", l_partkey="l_partkey", hours=_HOURS, rate=_RATE, tax_rate=_TAX)

_HEAD = ("Gross Pay  : ", f"=CAST({_GROSS} AS STRING)", NL, "Tax Amount : ", f"=CAST({_TAKEN} AS STRING)", NL)
_OFF = ("CASE WHEN l_partkey % 13 = 0 THEN CAST(0.01 AS DECIMAL(6,4)) "
        "WHEN l_partkey % 11 = 0 THEN CAST(0.0001 AS DECIMAL(6,4)) ELSE CAST(0 AS DECIMAL(6,4)) END")
_LABEL = "CASE WHEN l_partkey % 17 = 0 THEN 'Take Home  :  ' ELSE 'Net Pay    :  ' END"
_LAST = f"CASE WHEN l_partkey % 19 = 0 THEN 'n/a' ELSE CAST(CAST({_NET} + {_OFF} AS DECIMAL(15,4)) AS STRING) END"
REPORT_PAIRS = Carrier(
    "lineitem", l_orderkey="l_orderkey", l_partkey="l_partkey",
    expected=text_of(*_HEAD, "Net Pay    : ", f"=CAST({_NET} AS STRING)"),
    actual=text_of(*_HEAD, "=" + _LABEL, "=" + _LAST),
)

_PRICE = "CAST(o_totalprice AS DECIMAL(11,2))"
EXPECTED_LINES = Carrier(
    "orders", key="o_orderkey",
    text=text_of("Order ", "=CAST(o_orderkey AS STRING)", " Total: ", f"=CAST({_PRICE} AS STRING)"))
ACTUAL_LINES = Carrier(
    "orders", key="CASE WHEN o_orderkey % 50 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END",
    text=text_of("=CASE WHEN o_orderkey % 17 = 0 THEN 'Sale  ' ELSE 'ORDER  ' END", "=CAST(o_orderkey AS STRING)",
                 "=CASE WHEN o_orderkey % 19 = 0 THEN ' Total ' ELSE concat(' Total:  ', CAST("
                 f"CAST({_PRICE} + CASE WHEN o_orderkey % 13 = 0 THEN CAST(0.01 AS DECIMAL(6,4)) "
                 "WHEN o_orderkey % 11 = 0 THEN CAST(0.0001 AS DECIMAL(6,4)) ELSE CAST(0 AS DECIMAL(6,4)) END "
                 "AS DECIMAL(15,4)) AS STRING)) END"))


def _when(test: str, *lines: str) -> str:
    body = [x for line in lines for x in (line, NL)]
    return f"=CASE WHEN {test} THEN {text_of(*body)} ELSE '' END"


def _line(*parts: str) -> str:
    return "=" + text_of(*parts, NL)


_KEY = "CAST(o_orderkey AS STRING)"
_PROGRAM = text_of(
    _line("       IDENTIFICATION DIVISION."),
    _line("       PROGRAM-ID. PGM", f"={_KEY}", "."),
    _line("       DATA DIVISION."),
    _when("o_orderkey % 5 = 0", "       FD  ORDER-FILE", "           RECORDING MODE F."),
    _line("       WORKING-STORAGE SECTION."),
    _line("       01 WS-KEY        PIC X(8)."),
    _when("o_orderkey % 3 = 0", "       01 WS-SALE-REC.", "          05 SALE-NO        PIC X(12).",
          "          05 SALE-WORTH     PIC S9(8)V99 COMP-3."),
    _when("o_orderkey % 4 = 0", "       01 WS-RESP       PIC 9(4) COMP."),
    _when("o_orderkey % 7 = 0", "       01 BASKET-TABLE.", "          05 ROW-SLOT OCCURS 6 TIMES.",
          "             10 ROW-PART   PIC X(9).", "             10 ROW-PRICE  PIC S9(6)V99 PACKED-DECIMAL."),
    _line("       PROCEDURE DIVISION."),
    _when("o_orderstatus = 'F'", "           EXEC CICS READ", "               FILE('BUYERS')",
          "               INTO(WS-SALE-REC)", "               RIDFLD(WS-KEY)", "               RESP(WS-RESP)",
          "           END-EXEC"),
    "=CASE WHEN o_orderstatus = 'P' THEN " + text_of(
        "           exec cics writeq ts queue('Q", "=CAST(o_custkey % 10 AS STRING)",
        "') from(ws-msg) item(ws-item) end-exec", NL) + " ELSE '' END",
    _when("o_orderkey % 6 = 0", "           EXEC CICS RETURN END-EXEC"),
    _when("o_orderkey % 2 = 0", "           COMPUTE WS-TOTAL ROUNDED = WS-A * 1.05.", "           MOVE WS-TOTAL TO WS-OUT."),
    _when("o_orderkey % 11 = 0", "           PERFORM CALC-LOAN UNTIL WS-EOF."),
    _when("o_orderkey % 6 = 0", "           EXEC CICS RETURN END-EXEC."),
    "           STOP RUN.", NL,
)
PROGRAMS = Carrier("orders", path="CAST(o_orderkey AS BIGINT)", text=_PROGRAM)

STORED_PROGRAMS = Carrier("supplier", path="CAST(s_suppkey AS BIGINT)", text=text_of(
    _line("       IDENTIFICATION DIVISION."),
    _line("       PROGRAM-ID. SUP", "=CAST(s_suppkey AS STRING)", "."),
    _line("       PROCEDURE DIVISION."),
    _when("s_nationkey % 2 = 0", "           DISPLAY 'EVEN'."),
    _line("           DISPLAY '", "=s_name", "'."),
    "           STOP RUN.",
))

COPYBOOKS = Carrier("part", path="CAST(p_partkey AS BIGINT)", text=text_of(
    _line("       01 PART-RECORD."),
    "=" + text_of("          05 PART-ID        PIC X(", "=CAST(4 + p_partkey % 6 AS STRING)", ").", NL),
    "=" + text_of("          05 PART-PRICE     PIC S9(", "=CAST(5 + p_size % 4 AS STRING)", ")V99 COMP-3.", NL),
    "=" + text_of("          05 PART-QTY       PIC 9(", "=CAST(1 + p_partkey % 18 AS STRING)", ") COMP.", NL),
    "=" + text_of("          05 PART-SIZES OCCURS ", "=CAST(1 + p_partkey % 4 AS STRING)", " TIMES PIC 9(3).", NL),
    "=" + text_of("          05 PART-ROW OCCURS ", "=CAST(2 + p_size % 3 AS STRING)", " TIMES.", NL),
    _line("             10 ROW-CODE    PIC X(6)."),
    _line("             10 ROW-PRICE   PIC S9(8)V99 COMP-3."),
    _line("          05 PART-STAMP     PIC 9(9)."),
    _line("          05 STAMP-PARTS REDEFINES PART-STAMP."),
    _line("             10 STAMP-HIGH  PIC 9(6)."),
    _line("             10 STAMP-LOW   PIC 9(3)."),
    _line("          05 PART-FLAG      PIC X."),
    _line("             88 PART-OK VALUE 'Y'."),
))

DEPOSITS = Carrier(
    "orders", cust_no="CASE WHEN o_orderkey % 10 = 0 THEN -o_custkey - 1 ELSE o_custkey END",
    amount="CAST(o_totalprice AS DECIMAL(11,2))", order_no="o_orderkey")
ACCOUNTS = Carrier("customer", cust_no="c_custkey", name="c_name", balance="CAST(c_acctbal AS DECIMAL(18,2))")

ORDER_KEYS = Carrier(
    "orders", order_key="concat(lpad(CAST(o_custkey AS STRING), 19, '0'), lpad(CAST(o_orderkey AS STRING), 19, '0'))",
    order_amt="CAST(o_totalprice AS DECIMAL(11,2))")

ATTEMPTS = Carrier(
    "events",
    run_id="concat(CAST(user_id AS STRING), '-', CAST(" + ymd("ts") + " AS STRING))",
    attempt="CAST(1 + (hour(ts) - hour(ts) % 4) / 4 AS INT)",
    seq="event_id",
    stage="CASE event_type WHEN 'view' THEN 'llm_call' WHEN 'click' THEN 'pytest' WHEN 'error' THEN 'equivalence' "
          "WHEN 'purchase' THEN 'success' ELSE 'pytest' END",
    status="CASE event_type WHEN 'view' THEN 'error' WHEN 'click' THEN 'error' WHEN 'error' THEN 'error' "
           "ELSE 'success' END",
    message="props",
)
