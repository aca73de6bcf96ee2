"""Product-catalogue, quotation and usage-event jobs written as Spark DataFrame plans."""
