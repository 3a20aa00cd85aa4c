"""Order-fulfilment metrics as Spark DataFrame plans."""
