"""Demand, stock and pricing analytics for perishable goods, as Spark DataFrame operators."""
