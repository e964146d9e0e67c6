"""factloom: ontology, rule and text analytics on Spark DataFrames."""
