"""Radio-coverage analytics and the data work around it, as PySpark DataFrame operators."""
