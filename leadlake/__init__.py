"""leadlake: DataFrame operators that turn landed award documents into ranked, explainable leads."""
