"""The registered queries of the warehouse and their SQL."""
