"""Safety and governance policies over language-model traffic, evaluated set-wise on Spark DataFrames."""
