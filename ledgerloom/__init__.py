"""ledgerloom: a Spark-native household-spend, receipt-audit and corpus engine."""
