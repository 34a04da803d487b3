"""attestor: evidence retrieval analytics on Spark DataFrames.

``functions`` holds column expressions, ``operators`` DataFrame transforms, ``sources`` readers and
writers, ``plans`` whole pipelines over the driver's tables, ``streaming`` the streaming extensions.
"""
