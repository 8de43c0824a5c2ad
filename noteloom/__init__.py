"""noteloom: a Spark-native engine for collections of linked text documents."""
