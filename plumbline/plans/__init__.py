"""The few shared Spark plans that carry nearly every operator."""
