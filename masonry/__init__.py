"""Building-portfolio analytics and corpus preparation on Spark DataFrames."""
