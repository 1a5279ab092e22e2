"""Résumé, job, match and event tables derived from the given tables, row by row or by grouping them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talentloom import rules, schemas

_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
           "benchmark labels conversations").split()


class Tables:
    """Lazy Parquet tables of a folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """The rows in as many tasks as the session asks for with ``spark.talentloom.tasks``; as they lie if it asks for none.

        For tables that lie in one row group, which no scan can split.
        """
        tasks = self.spark.conf.get("spark.talentloom.tasks", None)
        return df.repartition(int(tasks)) if tasks else df

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """The rows dealt by their key to as many tasks as the session asks for, or else to the shuffle partitions of the session, which it may coalesce.

        For short rows that become texts: the work on a text is far more than its row, and neither a table in one row group nor a broadcast join deals it out.
        """
        tasks = self.spark.conf.get("spark.talentloom.tasks", None)
        return df.repartition(int(tasks), key) if tasks else df.repartition(key)

    def texts(self) -> DataFrame:
        return self.spread(self.documents)

    # ---- people ----------------------------------------------------------
    def resumes_v(self) -> DataFrame:
        places = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return self.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("resume_id"), F.col("c_name").alias("full_name"),
            F.col("c_mktsegment").alias("industry"), F.col("n_name").alias("country"), F.col("r_name").alias("region"),
            F.col("c_acctbal").alias("expectation"),
        )

    def experience_v(self) -> DataFrame:
        return self.orders.select(
            F.col("o_custkey").alias("resume_id"), F.col("o_orderkey").alias("exp_id"),
            F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("date").alias("start_date"),
            (F.col("o_orderstatus") == "O").alias("is_current"), F.col("o_totalprice").alias("salary"),
        )

    def employment_v(self) -> DataFrame:
        start = F.col("o_orderdate").cast("date")
        return self.orders.select(
            F.col("o_custkey").alias("resume_id"), F.col("o_orderkey").alias("exp_id"), start.alias("start_date"),
            F.date_add(start, (F.col("o_orderkey") % 400).cast("int")).alias("end_date"),
        )

    def _skill(self):
        return F.lower(F.concat_ws(" ", "p_type", "p_name"))

    def skill_lines(self) -> DataFrame:
        """One row per line item: who, which skill, when."""
        return (
            self.lineitem.select("l_orderkey", "l_partkey")
            .join(self.orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.part.select("p_partkey", "p_type", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("o_custkey").alias("resume_id"), F.col("o_orderdate").cast("date").alias("seen_on"), F.col("p_type").alias("category"),
                self._skill().alias("skill"),
            )
        )

    def resume_skills_v(self) -> DataFrame:
        # dealt by candidate, so that what follows per candidate does not deal the texts once more
        return self.skill_lines().select("resume_id", "category", "skill").repartition("resume_id").distinct()

    def skill_dates_v(self) -> DataFrame:
        return self.skill_lines().select("resume_id", "seen_on", "skill").distinct()

    # ---- jobs ------------------------------------------------------------
    def _job(self):
        """A job: what a supplier shipped in one month."""
        shipped = F.col("l_shipdate").cast("date")
        return F.col("l_suppkey") * 1000 + (F.year(shipped) - 1990) * 12 + F.month(shipped)

    def employers_v(self) -> DataFrame:
        places = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return self.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("employer_id"), F.col("s_name").alias("title"), F.col("n_name").alias("country"),
            F.col("r_name").alias("region"), F.col("s_acctbal").alias("salary_min"),
            (F.col("s_acctbal") + 5000).alias("salary_max"),
        )

    def with_employer(self, jobs: DataFrame) -> DataFrame:
        """Rows with a job_id beside the employer of the job."""
        return jobs.withColumn("employer_id", F.expr("job_id div 1000")).join(self.employers_v(), "employer_id").drop("employer_id")

    def jobs_v(self) -> DataFrame:
        return self.with_employer(self.lineitem.select(self._job().alias("job_id")).distinct())

    def job_skills_v(self) -> DataFrame:
        """Every skill of a job with its need: required where a line asks for more than 25 pieces."""
        lines = self.lineitem.select(self._job().alias("job_id"), "l_partkey", "l_quantity").join(
            self.part.select("p_partkey", "p_type", "p_name"), F.col("l_partkey") == F.col("p_partkey")
        )
        need = F.when(F.max("l_quantity") > 25, "required").otherwise("preferred")
        # dealt by job, so that the lists of a job are gathered where its lines are
        dealt = lines.select("job_id", self._skill().alias("skill"), "l_quantity").repartition("job_id")
        return dealt.groupBy("job_id", "skill").agg(need.alias("need"))

    def applications_v(self) -> DataFrame:
        """Asked pairs: a candidate applied to every job that one of the orders was shipped by."""
        return (
            self.lineitem.select("l_orderkey", self._job().alias("job_id"))
            .join(self.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").alias("resume_id"), "job_id").repartition("job_id").distinct()
        )

    # ---- events and pages --------------------------------------------------
    def status_events_v(self) -> DataFrame:
        kind = F.col("event_type")
        status = (
            F.when(kind == "signup", rules.PROCESSING).when(kind.isin("view", "click"), rules.AI_PROCESSING)
            .when(kind == "purchase", rules.COMPLETED).otherwise(rules.AI_FAILED)
        )
        return self.events.select("event_id", F.col("user_id").alias("resume_id"), "ts", status.alias("status"))

    def batch_events_v(self) -> DataFrame:
        return self.status_events_v().withColumn("batch", F.expr("event_id div 50"))

    def doc_pages_v(self) -> DataFrame:
        return self.conversations.select(
            F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.col("text").alias("page_text")
        )

    # ---- stored records ------------------------------------------------------
    def stored_resumes_v(self) -> DataFrame:
        """Flat record rows: customers with the latest status of their events (null without events)."""
        from talentloom.operators.records import latest_status

        person = self.resumes_v()
        status = latest_status(self.status_events_v()).select(
            F.col("resume_id").alias("_id"), F.col("status").alias("processing_status"),
            F.col("ts").cast("timestamp").alias("processed_at"),
        )
        none = F.lit(None)
        info = F.struct(
            F.struct(none.cast("string").alias("first"), none.cast("string").alias("last"), F.col("full_name").alias("full")).alias("name"),
            F.struct(
                F.concat(F.lower(F.regexp_replace("full_name", "#", ".")), F.lit("@mail.example.com")).alias("email"),
                none.cast("string").alias("phone"),
                F.struct(none.cast("string").alias("street"), none.cast("string").alias("city"), F.col("region").alias("state"),
                         none.cast("string").alias("zipCode"), F.col("country").alias("country")).alias("address"),
                none.cast("string").alias("linkedin"), none.cast("string").alias("website"),
            ).alias("contact"),
        )
        doc = F.struct(
            info.alias("personalInfo"),
            F.struct(none.cast("string").alias("text"), none.cast("string").alias("careerLevel"),
                     F.col("industry").alias("industryFocus"), none.cast("double").alias("yearsOfExperience")).alias("summary"),
            none.cast(schemas.DOC["experience"].dataType).alias("experience"),
            none.cast(schemas.DOC["education"].dataType).alias("education"),
            none.cast(schemas.SKILLS).alias("skills"),
            none.cast(schemas.DOC["certifications"].dataType).alias("certifications"),
        ).cast(schemas.DOC)
        blocks = {f.name: none.cast(f.dataType) for f in schemas.ENHANCEMENTS.fields}
        blocks["completenessScore"] = F.floor(F.abs("expectation") / 100).cast("int")
        done = F.col("processing_status") == rules.COMPLETED
        return person.join(status, F.col("resume_id") == F.col("_id"), "left").select(
            F.col("resume_id").alias("id"), F.concat("full_name", F.lit(".pdf")).alias("file_name"),
            F.round(F.abs("expectation") * 100, 0).cast("bigint").alias("file_size"),
            F.lit(rules.MEDIA_PDF).alias("file_type"), "processing_status",
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("uploaded_at"), "processed_at",
            F.lit(None).cast("string").alias("raw_text"),
            F.when(done, doc).alias("structured_data"),
            F.when(done, F.struct(*[v.alias(k) for k, v in blocks.items()])).alias("ai_enhancements"),
        )

    def wanted_ids_v(self) -> DataFrame:
        """Ids to look up: every order key; those beyond the customers are not found."""
        return self.orders.select(F.col("o_orderkey").alias("id"))

    def stored_matches_v(self) -> DataFrame:
        """Match rows: one per application, status by the key of the job."""
        status = F.when(F.col("job_id") % 3 == 0, rules.PENDING).when(F.col("job_id") % 3 == 1, rules.COMPLETED).otherwise(rules.FAILED)
        result = F.when((F.col("job_id") % 2 == 1) & (F.col("status") != rules.PENDING),
                        F.concat(F.lit('{"overallScore": '), F.col("resume_id").cast("string"), F.lit("}")))
        return self.applications_v().withColumn("status", status).select(
            F.concat_ws("-", "resume_id", "job_id").alias("id"), "resume_id", "job_id", "status",
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
            F.lit(None).cast("timestamp").alias("completed_at"), result.alias("match_result"),
        )

    # ---- résumé texts ----------------------------------------------------------
    def resume_texts_v(self) -> DataFrame:
        """One résumé text per order, in the usual form, from the order and its customer."""
        person = self.resumes_v()
        role = self.orders.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("resume_id"), F.col("o_orderpriority").alias("title"),
            F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("mark"),
            F.floor("o_totalprice").cast("bigint").alias("amount"),
        )
        c = F.col
        until = F.when(c("mark") == "O", F.lit("Present")).otherwise((c("year") + 2).cast("string"))
        born = c("year") - 5
        text = F.concat(
            c("full_name"), F.lit("\n\n"),
            c("id").cast("string"), F.lit(" Canal Row, "), c("region"), F.lit(", "), c("country"),
            F.lit(" | (312) 470-"), F.lpad((c("id") % 10000).cast("string"), 4, "0"),
            F.lit(" | user"), c("id").cast("string"), F.lit("@mail.example.com | linkedin.com/in/user"), c("id").cast("string"),
            F.lit("\n\n---\nProfile\n---\n\nWorked in "), c("industry"), F.lit(" for many years.\n\n---\nEmployment\n---\n\n"),
            c("title"), F.lit("\n"), c("industry"), F.lit(" Inc., "), c("region"), F.lit(", "), c("country"),
            F.lit("\n("), c("year").cast("string"), F.lit(" – "), until, F.lit(")\n- Shipped "), c("amount").cast("string"),
            F.lit(" crates of "), c("industry"), F.lit("\n\n---\nEducation\n---\n\nBachelor of Science in "), c("region"),
            F.lit("\nUniversity of "), c("country"), F.lit(", "), c("region"), F.lit("\n("), (born - 4).cast("string"), F.lit(" – "),
            born.cast("string"), F.lit(")\n- Class of "), born.cast("string"),
            F.lit("\n\n---\nSkills\n---\n\n- Sectors: "), c("industry"), F.lit(", "), c("region"), F.lit(" ("), c("country"), F.lit(", trade)\n- Soft skills: "),
            c("title"), F.lit("\n\n---\nCertifications\n---\n\n"), c("industry"), F.lit(" Certificate\nInstitute of "), c("region"),
            F.lit("\n(Issued: "), c("year").cast("string"), F.lit(")"),
        )
        return self.dealt(role.join(person, "resume_id"), "id").select("id", "resume_id", text.alias("raw_text"))

    def resume_layouts_v(self) -> DataFrame:
        """One résumé text per order in one of four forms without rules, by its key: one-line entries under capitals; no headings at all; employer before
        title under usual names; dates before both."""
        c = F.col
        person = self.resumes_v()
        role = self.orders.select(
            c("o_orderkey").alias("id"), c("o_custkey").alias("resume_id"), F.year("o_orderdate").alias("year"), c("o_orderstatus").alias("mark"),
            F.floor("o_totalprice").cast("bigint").cast("string").alias("amount"),
        )

        def pick(*names):
            return F.element_at(F.array(*[F.lit(n) for n in names]), ((F.floor(c("id") / 4)) % 4 + 1).cast("int"))

        branch = F.concat(F.substring("industry", 1, 1), F.lower(F.expr("substring(industry, 2)")))
        rows = self.dealt(role.join(person, "resume_id"), "id").select(
            "*", pick("Senior Accountant", "Data Engineer", "Ward Nurse", "Project Manager").alias("title1"),
            pick("Bookkeeper", "Software Developer", "Shift Supervisor", "Research Assistant").alias("title2"),
            F.concat(branch, F.lit(" Group")).alias("firm1"), F.concat(F.lit("Quay "), branch, F.lit(" Ltd")).alias("firm2"),
            F.concat_ws(", ", "region", "country").alias("place"),
            F.when(c("mark") == "O", F.lit("Present")).otherwise((c("year") + 2).cast("string")).alias("until"),
        )

        def year(back: int):
            return (c("year") - back).cast("string")

        def text(*parts):
            return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

        top = text(c("full_name"), "\n", c("id").cast("string"), " Canal Row, ", c("place"), " | user", c("id").cast("string"), "@mail.example.com | (312) 470-",
                   F.lpad((c("id") % 10000).cast("string"), 4, "0"), "\n\nWorked in ", c("industry"), " for many years.\n\n")
        moved, planned = text("Moved ", c("amount"), " crates"), "Planned the work of nine people"
        forms = [
            text("EXPERIENCE\n", c("title1"), " | ", c("firm1"), ", ", c("place"), " | ", year(0), " - ", c("until"), "\n- ", moved, "\n",
                 c("title2"), " | ", c("firm2"), ", ", c("place"), " | ", year(4), " - ", year(1), "\n- ", planned, ", with\n  reports to the board\n\n",
                 "EDUCATION\nBSc Accounting, University of ", c("country"), ", ", year(5), "\nDiploma in Trade, College of ", c("region"), ", ", year(8),
                 "\n\nSKILLS\nExcel, SQL, ", c("industry"), "\n\nCERTIFICATIONS\nACCA, Institute of ", c("region"), ", ", year(0), "\nCertified Planner (", year(1), ")"),
            text(c("title1"), "\n", c("firm1"), ", ", c("place"), "\n", year(0), " – ", c("until"), "\nMoved goods for the whole branch.\n- ", moved, "\n\n",
                 c("title2"), "\n", c("firm2"), ", ", c("place"), "\nMar ", year(4), " – Jul ", year(1), "\n- ", planned, "\n\n",
                 "Master of Science in Trade\nUniversity of ", c("country"), ", ", c("place"), "\n", year(7), " – ", year(5), "\n\n",
                 "Bachelor of Arts in History\nCollege of ", c("region"), ", ", c("place"), "\n", year(10), " – ", year(8), "\n- GPA: 3.5\n\n",
                 "Excel, SQL, ", c("industry"), "\n\nCertified Planner\nIssued: ", year(0)),
            text("Employment History\n", c("firm1"), ", ", c("place"), "\n", c("title1"), "\n", year(0), " - ", c("until"), "\n• ", moved, "\n\n",
                 c("firm2"), ", ", c("place"), "\n", c("title2"), "\n", year(4), " - ", year(1), "\n• ", planned, "\n\n",
                 "Education\nUniversity of ", c("country"), ", ", c("place"), "\nDiploma in Trade\n", year(7), " - ", year(5), "\n\n",
                 "Skills\n• Excel\n• SQL\n• ", c("industry"), "\n\nLanguages\nGerman (native), English\n\nCertifications\nCertified Planner – Institute of ", c("region"), ", ",
                 year(0)),
            text("Work Experience\n", year(0), " – ", c("until"), "\n", c("title1"), ", ", c("firm1"), ", ", c("place"), "\n", moved, " of goods.\n\n",
                 year(4), " – ", year(1), "\n", c("title2"), " at ", c("firm2"), "\n", planned, ".\n\nEducation\n", year(7), " – ", year(5),
                 "\nLicence in Trade, University of ", c("country"), ", ", c("country"), "\n\nKey Skills\nPlanning: rotas, stock\nTools: Excel, ", c("industry"),
                 "\n\nCertificates\nCertified Planner\nInstitute of ", c("region"), "\n(Issued: ", year(0), ", Expires: ", year(-3), ")"),
        ]
        form = F.when(c("id") % 4 == 0, forms[0]).when(c("id") % 4 == 1, forms[1]).when(c("id") % 4 == 2, forms[2]).otherwise(forms[3])
        return rows.select("id", "resume_id", F.concat(top, form).alias("raw_text"))
