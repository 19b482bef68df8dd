"""fintally: ledger analytics as lazy Spark DataFrame operators.

Every operator is a function ``DataFrame(s) + parameters (+ explicit as_of) -> DataFrame``.
Nothing inside an operator collects data to the driver.
"""

__version__ = "0.1.0"
