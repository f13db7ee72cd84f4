# Databricks notebook source
from pyspark.sql.functions import col, lit, when, coalesce, concat, struct, sort_array, collect_list

# COMMAND ----------

# MAGIC %md
# MAGIC Load the member tables

# COMMAND ----------

member_tables = ['member_base', 'member_addr']
code_tables = ["state_codes"]
base_df = create_dataframe_from_table(spark, schema, member_tables)
addr_df = dm_df["member_addr"]
state_df = spark.table("ref.state_codes")
active_df = base_df.filter(col("status") == "A")
recent_df = active_df.select("member_id", "state_cd", "first_name", "last_name")

# COMMAND ----------

joined_df = recent_df.join(
    state_df.select(col("cd"), col("txt")),
    (col("state_cd") == col("cd")),
    "left"
)
both_df = joined_df.join(addr_df, joined_df.member_id == addr_df.member_id)
both_df = both_df.withColumn("full_name", concat(col("first_name"), lit(" "), col("last_name")))
both_df = both_df.withColumn("state_name", when(col("txt").isNotNull(), col("txt")).otherwise(lit("unknown")))
both_df = both_df.withColumn("addresses", sort_array(collect_list(struct(col("line1").alias("address_line_1"), col("city").alias("city")))))

# COMMAND ----------

# MAGIC %sql
# MAGIC SELECT member_id,
# MAGIC        CASE WHEN state_cd = 'MD' THEN 'Maryland' END AS state
# MAGIC FROM silver.member

# COMMAND ----------

dq_rule_string = """
Member
    member_id must not be null
    length(state_cd) must be 2
    member_id must be source_id
"""
target_table = f"{database}.silver.member"
both_df.write.mode("overwrite").insertInto(target_table)
