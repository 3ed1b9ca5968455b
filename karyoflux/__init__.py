"""karyoflux: cohort-scale rearrangement analytics on Spark DataFrames."""
