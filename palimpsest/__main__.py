from palimpsest.plans.runner import main

main()
