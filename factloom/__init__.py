"""factloom: review signals and corpus preparation as Spark DataFrame programs."""
