"""Operations data on Spark: metric samples, logs, flows and events as DataFrame operators."""
