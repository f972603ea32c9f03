"""Column functions: DataFrame column in, DataFrame column out, all JVM-side."""
