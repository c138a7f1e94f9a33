"""Set-wise operators of the warehouse, each a DataFrame in and a DataFrame out."""
