"""Bank export formats, column-name aliases and merchant patterns used by the importer."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Known bank export formats, in the reference's order.
# (format_id, name, institution, account_type, headers, signature columns,
#  mapping: date, merchant, amount, description, debit_column, credit_column)
# ---------------------------------------------------------------------------
BANK_FORMATS = [
    ("chase_credit", "Chase Credit Card", "Chase", "credit_card",
     ["Transaction Date", "Post Date", "Description", "Category", "Type", "Amount"],
     ["Transaction Date", "Post Date", "Category", "Type"],
     ("Transaction Date", "Description", "Amount", "Category", None, None)),
    ("chase_checking", "Chase Checking/Savings", "Chase", "checking",
     ["Details", "Posting Date", "Description", "Amount", "Type", "Balance", "Check or Slip #"],
     ["Details", "Posting Date", "Check or Slip #"],
     ("Posting Date", "Description", "Amount", "Details", None, None)),
    ("bofa", "Bank of America", "Bank of America", "checking",
     ["Posted Date", "Reference Number", "Payee", "Address", "Amount"],
     ["Reference Number", "Payee", "Address"],
     ("Posted Date", "Payee", "Amount", "Address", None, None)),
    ("wells_fargo", "Wells Fargo", "Wells Fargo", "checking",
     ["Date", "Amount", "Description"],
     [],
     ("Date", "Description", "Amount", None, None, None)),
    ("capital_one", "Capital One", "Capital One", "credit_card",
     ["Transaction Date", "Posted Date", "Card No.", "Description", "Category", "Debit", "Credit"],
     ["Card No.", "Debit", "Credit"],
     ("Transaction Date", "Description", "Debit", "Category", "Debit", "Credit")),
    ("citi", "Citi", "Citi", "credit_card",
     ["Status", "Date", "Description", "Debit", "Credit"],
     ["Status", "Debit", "Credit"],
     ("Date", "Description", "Debit", None, "Debit", "Credit")),
    ("amex", "American Express", "American Express", "credit_card",
     ["Date", "Description", "Card Member", "Account #", "Amount"],
     ["Card Member", "Account #"],
     ("Date", "Description", "Amount", None, None, None)),
    ("discover", "Discover", "Discover", "credit_card",
     ["Trans. Date", "Post Date", "Description", "Amount", "Category"],
     ["Trans. Date", "Post Date", "Category"],
     ("Trans. Date", "Description", "Amount", "Category", None, None)),
    ("usaa", "USAA", "USAA", "checking",
     ["Date", "Description", "Original Description", "Category", "Amount"],
     ["Original Description"],
     ("Date", "Description", "Amount", "Original Description", None, None)),
    ("navy_federal", "Navy Federal Credit Union", "Navy Federal", "checking",
     ["Date", "Description", "Amount", "Balance"],
     ["Balance"],
     ("Date", "Description", "Amount", None, None, None)),
    ("pnc", "PNC Bank", "PNC", "checking",
     ["Date", "Description", "Withdrawals", "Deposits", "Balance"],
     ["Withdrawals", "Deposits", "Balance"],
     ("Date", "Description", "Withdrawals", None, "Withdrawals", "Deposits")),
    ("td_bank", "TD Bank", "TD Bank", "checking",
     ["Date", "Activity", "Credited", "Debited"],
     ["Activity", "Credited", "Debited"],
     ("Date", "Activity", "Debited", None, "Debited", "Credited")),
    ("us_bank", "US Bank", "US Bank", "checking",
     ["Date", "Transaction", "Name", "Memo", "Amount"],
     ["Transaction", "Name", "Memo"],
     ("Date", "Name", "Amount", "Memo", None, None)),
    ("mint", "Mint Export", "Mint", "aggregator",
     ["Date", "Description", "Original Description", "Amount", "Transaction Type", "Category", "Account Name"],
     ["Original Description", "Transaction Type", "Account Name"],
     ("Date", "Description", "Amount", "Original Description", None, None)),
    ("venmo", "Venmo", "Venmo", "payment_app",
     ["ID", "Datetime", "Type", "Status", "Note", "From", "To", "Amount (total)", "Amount (fee)"],
     ["ID", "Datetime", "Type", "Status", "Note", "From", "To"],
     ("Datetime", "Note", "Amount (total)", "Type", None, None)),
    ("paypal", "PayPal", "PayPal", "payment_app",
     ["Date", "Time", "TimeZone", "Name", "Type", "Status", "Currency", "Gross", "Fee", "Net"],
     ["TimeZone", "Currency", "Gross", "Fee", "Net"],
     ("Date", "Name", "Gross", "Type", None, None)),
    ("apple_card", "Apple Card", "Apple", "credit_card",
     ["Transaction Date", "Clearing Date", "Description", "Merchant", "Category", "Type", "Amount"],
     ["Clearing Date", "Merchant", "Type"],
     ("Transaction Date", "Merchant", "Amount", "Category", None, None)),
    ("sofi", "SoFi", "SoFi", "checking",
     ["Date", "Description", "Type", "Amount", "Balance"],
     ["Type", "Balance"],
     ("Date", "Description", "Amount", "Type", None, None)),
    ("ally", "Ally Bank", "Ally", "checking",
     ["Date", "Time", "Amount", "Type", "Description"],
     ["Time", "Type"],
     ("Date", "Description", "Amount", "Type", None, None)),
    ("marcus", "Marcus by Goldman Sachs", "Goldman Sachs", "savings",
     ["Date", "Description", "Amount", "Balance"],
     [],
     ("Date", "Description", "Amount", None, None, None)),
    ("alliant", "Alliant Credit Union", "Alliant", "checking",
     ["Post Date", "Effective Date", "Transaction Type", "Description", "Amount", "Balance"],
     ["Post Date", "Effective Date", "Transaction Type"],
     ("Post Date", "Description", "Amount", "Transaction Type", None, None)),
    ("ynab", "YNAB (You Need A Budget)", "YNAB", "aggregator",
     ["Account", "Flag", "Date", "Payee", "Category Group/Category", "Category Group", "Category", "Memo",
      "Outflow", "Inflow", "Cleared"],
     ["Account", "Flag", "Payee", "Category Group/Category", "Outflow", "Inflow", "Cleared"],
     ("Date", "Payee", "Outflow", "Memo", "Outflow", "Inflow")),
    ("personal_capital", "Empower (Personal Capital)", "Empower", "aggregator",
     ["Date", "Account", "Description", "Category", "Tags", "Amount"],
     ["Account", "Category", "Tags"],
     ("Date", "Description", "Amount", "Category", None, None)),
    ("generic", "Generic Format", "Unknown", "unknown",
     ["Date", "Amount", "Merchant", "Description"],
     [],
     ("Date", "Merchant", "Amount", "Description", None, None)),
]

# Column-name aliases per field, in priority order.
DATE_COLUMNS = ["date", "transaction date", "trans date", "posted date", "trans_date", "posting date",
                "post date", "effective date", "datetime", "trans. date", "clearing date", "settlement date",
                "value date"]
AMOUNT_COLUMNS = ["amount", "trans_amt", "transaction amount", "debit/credit", "value", "gross", "net", "total",
                  "amount (total)", "sum"]
DEBIT_COLUMNS = ["debit", "debited", "withdrawals", "withdrawal", "outflow", "expense", "payment", "charge",
                 "money out"]
CREDIT_COLUMNS = ["credit", "credited", "deposits", "deposit", "inflow", "income", "refund", "money in"]
MERCHANT_COLUMNS = ["merchant", "payee", "description", "payee_name", "vendor", "name", "to", "recipient",
                    "store", "company", "transaction"]
DESC_COLUMNS = ["description", "memo", "notes", "details", "original description", "address", "category",
                "note", "reference"]
BALANCE_COLUMNS = ["balance", "running balance", "available balance", "ledger balance"]

# Header words that mark the header line of an export.
HEADER_WORDS = ["date", "amount", "merchant", "payee", "description"]

# Merchant patterns (regular expressions, matched case-insensitively).
INCOME_PATTERNS = [r"direct deposit", r"payroll", r"salary", r"wages", r"paycheck", r"ach credit",
                   r"interest payment", r"dividend", r"refund", r"tax refund", r"venmo from", r"zelle from",
                   r"transfer from"]
SUBSCRIPTION_PATTERNS = [r"netflix", r"spotify", r"hulu", r"disney\+", r"amazon prime", r"apple\.com",
                         r"google\s*(play|storage|one)", r"microsoft", r"adobe", r"dropbox", r"youtube premium",
                         r"hbo\s*max"]

# Split debit/credit header detection (exact names; then substrings for the names).
SPLIT_DEBIT_NAMES = ["debit", "debited", "withdrawals", "outflow"]
SPLIT_CREDIT_NAMES = ["credit", "credited", "deposits", "inflow"]
SPLIT_DEBIT_PARTS = ["debit", "withdraw", "outflow"]
SPLIT_CREDIT_PARTS = ["credit", "deposit", "inflow"]

# Date patterns tried in order by the batch importer (Spark datetime patterns
# for %Y-%m-%d, %m/%d/%Y, %m/%d/%y, %d-%b-%Y, %d/%m/%Y, %Y/%m/%d).
DEFAULT_DATE_PATTERNS = ["yyyy-M-d", "M/d/yyyy", "M/d/yy", "d-MMM-yyyy", "d/M/yyyy", "yyyy/M/d"]
# Wizard import (%Y-%m-%d, %m/%d/%Y, %m/%d/%y, %d/%m/%Y).
WIZARD_DATE_PATTERNS = ["yyyy-M-d", "M/d/yyyy", "M/d/yy", "d/M/yyyy"]
# Onboarding import (%Y-%m-%d, %m/%d/%Y, %m-%d-%Y, %d/%m/%Y, %Y/%m/%d) on the first token.
ONBOARDING_DATE_PATTERNS = ["yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "yyyy/M/d"]

# Onboarding spending categories by merchant keyword, in order; the first
# category with a keyword contained in the lower-cased merchant wins, else "Other".
KEYWORD_CATEGORIES = [
    ("Housing", ["rent", "mortgage", "hoa", "property", "landlord"]),
    ("Utilities", ["electric", "gas", "water", "internet", "comcast", "verizon", "att", "t-mobile", "phone"]),
    ("Groceries", ["grocery", "kroger", "publix", "walmart", "target", "costco", "aldi", "trader joe",
                   "whole foods", "safeway", "fred meyer", "winco"]),
    ("Dining Out", ["restaurant", "cafe", "coffee", "starbucks", "mcdonald", "chipotle", "doordash", "grubhub",
                    "uber eats", "pizza", "jack in the box", "taco", "wendy", "burger"]),
    ("Transportation", ["gas", "shell", "exxon", "chevron", "bp", "uber", "lyft", "parking", "toll", "fuel"]),
    ("Shopping", ["amazon", "ebay", "etsy", "best buy", "home depot", "lowes", "clothing", "nike", "nordstrom"]),
    ("Entertainment", ["netflix", "spotify", "hulu", "disney", "hbo", "movie", "theater", "concert", "ticket"]),
    ("Healthcare", ["pharmacy", "cvs", "walgreens", "doctor", "medical", "hospital", "dental", "health"]),
    ("Insurance", ["insurance", "geico", "progressive", "allstate", "state farm"]),
    ("Subscriptions", ["subscription", "membership", "gym", "patreon", "apple.com", "google"]),
    ("Travel", ["airbnb", "hotel", "airline", "flight", "booking", "expedia", "vrbo"]),
]


def formats_df(spark: SparkSession) -> DataFrame:
    rows = [(i, f, n, inst, at, h, s, *m) for i, (f, n, inst, at, h, s, m) in enumerate(BANK_FORMATS)]
    return spark.createDataFrame(
        rows, "position int, format_id string, name string, institution string, account_type string, "
              "headers array<string>, signature_columns array<string>, map_date string, map_merchant string, "
              "map_amount string, map_description string, map_debit string, map_credit string")


def aliases_df(spark: SparkSession) -> DataFrame:
    """(field, alias, rank) for the name-based column detection."""
    rows = []
    for field, names in (("date", DATE_COLUMNS), ("amount", AMOUNT_COLUMNS), ("debit", DEBIT_COLUMNS),
                         ("credit", CREDIT_COLUMNS), ("merchant", MERCHANT_COLUMNS),
                         ("description", DESC_COLUMNS), ("balance", BALANCE_COLUMNS)):
        rows += [(field, a, r) for r, a in enumerate(names)]
    return spark.createDataFrame(rows, "field string, alias string, rank int")
