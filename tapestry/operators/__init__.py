"""DataFrame-level operators.  Each takes DataFrames and returns a DataFrame
(lazy); nothing is collected to the driver."""
