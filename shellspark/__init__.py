"""Structure of solutions from molecular-dynamics trajectories, as Spark DataFrame plans."""
