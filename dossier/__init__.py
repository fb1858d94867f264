"""dossier: a Spark-native case-analysis engine."""
