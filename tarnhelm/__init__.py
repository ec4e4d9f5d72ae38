"""tarnhelm: program-analysis facts, change impact, graphs, taint and rules as Spark DataFrames."""
