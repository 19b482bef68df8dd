"""Budgeting-method templates and the spending-category map used when blending actuals."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Budgeting-method templates, in the reference's order.
# (method_id, category name, type, percent of income, keywords)
# ---------------------------------------------------------------------------
METHOD_TEMPLATES = [
    ("fifty_thirty_twenty", "Housing", "needs", 25, "rent,mortgage,property tax"),
    ("fifty_thirty_twenty", "Utilities", "needs", 5, "electric,gas,water,internet,phone"),
    ("fifty_thirty_twenty", "Groceries", "needs", 10, "grocery,supermarket,food"),
    ("fifty_thirty_twenty", "Transportation", "needs", 10, "gas,fuel,uber,lyft,transit,parking"),
    ("fifty_thirty_twenty", "Insurance", "needs", 0, "insurance,premium"),
    ("fifty_thirty_twenty", "Dining Out", "wants", 5, "restaurant,cafe,coffee,doordash,grubhub"),
    ("fifty_thirty_twenty", "Entertainment", "wants", 5, "netflix,spotify,movie,concert,game"),
    ("fifty_thirty_twenty", "Shopping", "wants", 10, "amazon,target,walmart,clothing"),
    ("fifty_thirty_twenty", "Personal Care", "wants", 5, "haircut,salon,gym,spa"),
    ("fifty_thirty_twenty", "Travel", "wants", 5, "hotel,airbnb,airline,vacation"),
    ("fifty_thirty_twenty", "Savings", "savings", 15, "transfer,savings"),
    ("fifty_thirty_twenty", "Debt Payment", "savings", 5, "loan,credit card payment"),
    ("zero_based", "Giving/Charity", "fixed", 10, "donation,charity,tithe,church"),
    ("zero_based", "Emergency Fund", "savings", 5, "emergency,savings"),
    ("zero_based", "Retirement", "savings", 5, "401k,ira,retirement"),
    ("zero_based", "Housing", "fixed", 25, "rent,mortgage,hoa"),
    ("zero_based", "Utilities", "fixed", 5, "electric,gas,water,trash,internet"),
    ("zero_based", "Phone", "fixed", 2, "phone,cell,mobile,verizon,att"),
    ("zero_based", "Groceries", "variable", 8, "grocery,supermarket"),
    ("zero_based", "Restaurants", "variable", 4, "restaurant,dining,takeout"),
    ("zero_based", "Gas & Transportation", "variable", 8, "gas,fuel,parking,tolls"),
    ("zero_based", "Car Payment", "fixed", 5, "car payment,auto loan"),
    ("zero_based", "Car Insurance", "fixed", 3, "car insurance,auto insurance"),
    ("zero_based", "Health Insurance", "fixed", 5, "health insurance,medical"),
    ("zero_based", "Medical", "variable", 2, "doctor,pharmacy,medical"),
    ("zero_based", "Clothing", "variable", 3, "clothing,clothes,shoes"),
    ("zero_based", "Personal", "variable", 3, "haircut,personal,toiletries"),
    ("zero_based", "Entertainment", "variable", 5, "entertainment,netflix,spotify,fun"),
    ("zero_based", "Debt Payoff", "debt", 2, "loan,debt,credit card"),
    ("pay_yourself_first", "Savings (Auto)", "savings", 10, "auto transfer,savings"),
    ("pay_yourself_first", "Investments", "savings", 10, "investment,brokerage,stocks"),
    ("pay_yourself_first", "Fixed Bills", "fixed", 40, "rent,mortgage,utilities,insurance"),
    ("pay_yourself_first", "Daily Living", "variable", 25, "groceries,gas,food,transport"),
    ("pay_yourself_first", "Discretionary", "wants", 15, "entertainment,shopping,dining"),
    ("envelope", "Groceries", "envelope", 12, "grocery,food,supermarket"),
    ("envelope", "Gas", "envelope", 8, "gas,fuel"),
    ("envelope", "Dining Out", "envelope", 5, "restaurant,coffee,cafe"),
    ("envelope", "Entertainment", "envelope", 5, "movies,games,fun"),
    ("envelope", "Clothing", "envelope", 4, "clothes,shoes,apparel"),
    ("envelope", "Personal Care", "envelope", 3, "haircut,beauty,salon"),
    ("envelope", "Gifts", "envelope", 3, "gift,present,birthday"),
    ("envelope", "Household", "envelope", 5, "home,supplies,cleaning"),
    ("envelope", "Medical", "envelope", 5, "doctor,pharmacy,health"),
    ("envelope", "Savings", "savings", 15, "savings,transfer"),
    ("envelope", "Fixed Expenses", "fixed", 35, "rent,utilities,insurance,bills"),
    ("minimalist", "Bills & Essentials", "fixed", 50, "rent,mortgage,utilities,insurance,groceries,gas"),
    ("minimalist", "Spending Money", "variable", 30, "shopping,dining,entertainment,personal"),
    ("minimalist", "Savings & Goals", "savings", 20, "savings,investment,transfer"),
]

# Spending category (from a CSV analysis) -> template category, for blending.
SPEND_CATEGORY_MAP = [
    ("Groceries", "Food & Dining"),
    ("Food & Dining", "Food & Dining"),
    ("Dining Out", "Food & Dining"),
    ("Transportation", "Transportation"),
    ("Gas", "Transportation"),
    ("Utilities", "Utilities"),
    ("Entertainment", "Entertainment"),
    ("Shopping", "Shopping"),
    ("Healthcare", "Healthcare"),
    ("Insurance", "Insurance"),
    ("Personal Care", "Personal Care"),
    ("Subscriptions", "Subscriptions"),
]


def templates_df(spark: SparkSession) -> DataFrame:
    rows = [(m, i, n, t, p, k) for i, (m, n, t, p, k) in enumerate(METHOD_TEMPLATES)]
    return spark.createDataFrame(
        rows, "method_id string, position int, name string, type string, percent int, keywords string")


def category_map_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPEND_CATEGORY_MAP, "spend_category string, template_category string")
