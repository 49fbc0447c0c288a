"""Sales and customer-service analytics as Spark DataFrame operators.

Every operator is a plain function ``f(DataFrame, ..., params) -> DataFrame``;
nothing is collected to the driver and no wall clock is read (``as_of`` is
always an argument).
"""

__version__ = "0.1.0"
