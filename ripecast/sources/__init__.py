"""Reading, normalising and writing the sales, inventory and customer tables."""
