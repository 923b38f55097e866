"""tokenlake: a Spark-native analytics engine for discrete speech-token corpora."""
