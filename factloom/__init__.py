"""factloom: a Spark-first analytics engine for customer-relationship facts."""
