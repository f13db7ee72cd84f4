x = spark.table("raw.events"
y = x.select(col("a").alias("b")
